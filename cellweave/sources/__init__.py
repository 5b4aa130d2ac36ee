"""Scans, array chunks and table sinks."""
