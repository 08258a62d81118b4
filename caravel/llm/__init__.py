"""Training-data operators: deduplication, scanning, scoring, formatting.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
