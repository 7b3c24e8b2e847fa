"""Training-data operators: deduplication, mixing, packing, search, scans and scoring.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
