"""Streaming forms of the incremental operators (an extension)."""
