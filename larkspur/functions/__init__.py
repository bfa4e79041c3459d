"""Column builders: scores, bins, captions, tags, text rules."""
