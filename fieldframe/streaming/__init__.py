"""Incremental processing of frames as they land."""
