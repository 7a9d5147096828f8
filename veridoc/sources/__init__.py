"""Scans, discovery and sinks."""
