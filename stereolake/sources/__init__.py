"""Readers and writers of motion-capture files and tables."""
