"""Training-data operators: language ID, HTML extraction, near and exact deduplication, BPE, line
deduplication, token files, quality rules, URL filters and source mixing.

Nothing outside this subpackage imports it.
"""
