"""Structured Streaming counterparts of the incremental loops."""
