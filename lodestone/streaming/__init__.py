"""Structured Streaming twins of the log and cache operators (an extension)."""
