"""Training-data operators: deduplication, tokenizing, extraction, packing and media.

Nothing outside this subpackage imports it.
"""
