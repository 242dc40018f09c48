"""Training-data operators: dedup, decontamination, scoring, scans, tokens and filters.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries if it is there.
"""
