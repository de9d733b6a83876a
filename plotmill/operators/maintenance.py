"""Maintenance as projections: duplicates resolved, corrections applied, guarded updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_duplicates(pairs: DataFrame, rows: DataFrame, row_id: str, rank: Column) -> DataFrame:
    """``loser`` ids of the confirmed pairs (``id_a``, ``id_b``, ``kind``): the row of the lower rank goes, on equal ranks
    the later id. Numeric pairs are only for showing and resolve nothing. A row that loses several times is named once."""
    ranks = rows.select(F.col(row_id).alias("id"), F.coalesce(rank, F.lit(0)).alias("rank"))
    a, b = ranks.toDF("id_a", "rank_a"), ranks.toDF("id_b", "rank_b")
    judged = pairs.where("kind = 'confirmed'").join(a, "id_a").join(b, "id_b")
    return judged.select(F.when(F.col("rank_b") > F.col("rank_a"), F.col("id_a")).otherwise(F.col("id_b")).alias("loser")).distinct()


def apply_corrections(rows: DataFrame, truth: DataFrame, key: str, tolerances: dict[str, Column], together: dict[str, list[str]]) -> DataFrame:
    """Rows with the fields of ``truth`` (same names) that are beyond tolerance, and ``changed``, the names of these.

    A tolerance is an expression over ``old`` and ``new``. Unknown values (null, 0) on either side change nothing. Each
    field of ``together`` follows only if all the fields listed for it have changed. ``truth`` has one row per key.
    """
    new = truth.select(key, *[F.col(c).alias(f"__{c}") for c in (*tolerances, *together)])
    joined = rows.join(new, key, "left")

    def beyond(c: str) -> Column:
        known = (F.col(c) != 0) & (F.col(f"__{c}") != 0)
        pair = F.transform(F.array(F.struct(F.col(c).alias("old"), F.col(f"__{c}").alias("new"))), lambda p: F.abs(p["old"] - p["new"]))
        return F.coalesce(known & (F.get(pair, F.lit(0)) > tolerances[c]), F.lit(False))

    flags = {c: beyond(c) for c in tolerances}
    for c, needs in together.items():
        ok = F.col(f"__{c}").isNotNull()
        for n in needs:
            ok &= flags[n]
        flags[c] = F.coalesce(ok, F.lit(False))
    changed = F.array_join(F.array_compact(F.array(*[F.when(f, F.lit(c)) for c, f in flags.items()])), ",")
    kept = [F.when(flags[c], F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in flags else F.col(c) for c in rows.columns]
    return joined.select(*kept, changed.alias("changed"))


def advance_status(rows: DataFrame, updates: DataFrame, key: str, allowed: dict[str, str]) -> DataFrame:
    """Rows with the status of their update, where the row still has the status that the update expects and the step from
    it is allowed. ``updates``: key, ``expected``, ``status``; of several for a key the first by status counts."""
    steps = F.create_map(*[F.lit(x) for pair in allowed.items() for x in pair])
    one = updates.groupBy(key).agg(F.min(F.struct("status", "expected")).alias("u")).select(key, F.col("u.status").alias("__new"), F.col("u.expected").alias("__was"))
    ok = (F.col("status") == F.col("__was")) & (F.try_element_at(steps, F.col("status")) == F.col("__new"))
    return rows.join(one, key, "left").select(*[F.when(ok, F.col("__new")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in rows.columns])
