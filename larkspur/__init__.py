"""Rated, captioned training sets on Spark: selection, captions, screening and experiment statistics."""
