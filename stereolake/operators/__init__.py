"""Relational, window and grouped operators over motion-capture tables."""
