"""Training-data operators: near-duplicates, extraction, redaction, scoring, packing, mixing.

Nothing outside this folder imports it; the library works without it.
"""
