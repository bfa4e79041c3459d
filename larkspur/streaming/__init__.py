"""Incremental forms of the manifest operators."""
