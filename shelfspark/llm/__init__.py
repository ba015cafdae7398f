"""Training-data operators: mixing, token counts, scans, dedup, scoring, encoding, fingerprints.

Nothing outside this subpackage imports it. ``queries`` and ``oracle_sql`` of
``shelfspark.llm.queries`` are what the entry module registers.
"""
