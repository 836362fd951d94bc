"""Training-data operators: scoring, near-dedup, media, mixing, archives, tokenising.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
