"""Streaming forms of scans, redactions and sinks."""
