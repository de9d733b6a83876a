"""Registered queries: each maps (spark, sf_dir) to a DataFrame, most with equivalent SQL for an independent engine."""
