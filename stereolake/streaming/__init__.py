"""Structured Streaming counterparts of the frame loop."""
