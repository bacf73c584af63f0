"""Training-data operators: deduplication, fingerprints, mixing, archives, scans, packing and sharding.

Nothing outside this package imports it; ``queries`` registers its operators for the entry module.
"""
