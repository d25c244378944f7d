"""Readers, the file catalog, and sinks."""
