"""Incremental forms: new files in, finished ids remembered."""
