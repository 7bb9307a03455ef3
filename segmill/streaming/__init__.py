"""Streaming forms of the two batch loops (an extension)."""
