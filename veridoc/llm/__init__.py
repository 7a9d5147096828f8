"""Operators for large-scale training-data pipelines (URL filters to token counts)."""
