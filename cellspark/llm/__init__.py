"""Operators of a training-data pipeline (near-dedup, tokenisation, filtering, ...).

Nothing outside this subpackage imports it; ``cellspark.llm.registry`` holds the
queries that ``__spark_entry__`` adds when the subpackage is present.
"""
