"""Differences between two copies of a keyed table, by hierarchical checksums over key ranges.

The key space is cut into a few coarse ranges and each side gets a checksum per range. Only ranges whose checksums differ
are cut again, and only their rows are summed again, down to leaf ranges of a few keys. Rows are compared field by field
in the leaves that are left. Sums are combined before the shuffle, so equal ranges never move a row between executors.

A checksum is the sum of the rows' 64-bit hashes, in three parts, and their count. Sums, unlike exclusive ors, don't
cancel when a row is there twice. Rows of the right side count negatively, so a range is equal where all sums are 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmill.runtime import materialize

#: Keys per leaf range, and ranges that a range is cut into; the coarsest level has as many at most.
LEAF_KEYS = 8
FANOUT = 256

#: Bits of the hash summed apart. Sums of 22 bits hold 2 ** 41 rows of a range; beyond that Spark raises an error.
_PART = 22


def _hash(key: str, fields: list[str]) -> Column:
    # a null must not hash like an absent argument, hence the flag beside each value
    return F.xxhash64(key, *[x for f in fields for x in (F.col(f), F.col(f).isNull())])


def _range(key: str, width: int) -> Column:
    return F.floor(F.col(key) / width).cast("bigint")


def _differing(both: DataFrame, key: str, width: int) -> DataFrame:
    """The ranges of ``width`` keys whose checksums differ; ``both`` has ``key``, ``h`` and ``sign``."""
    parts = [F.shiftrightunsigned("h", k * _PART).bitwiseAND(F.lit((1 << _PART) - 1)) for k in range(3)]
    signed = both.select(_range(key, width).alias("range"), *[(p * F.col("sign")).alias(f"s{k}") for k, p in enumerate(parts)], "sign")
    sums = signed.groupBy("range").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(3)], F.sum("sign").alias("n"))
    return sums.where("s0 <> 0 or s1 <> 0 or s2 <> 0 or n <> 0").select("range")


def differing_ranges(left: DataFrame, right: DataFrame, key: str, fields: list[str], leaf_keys: int = LEAF_KEYS, fanout: int = FANOUT) -> list[DataFrame]:
    """The ranges whose checksums differ, one written table per level, from the coarsest down to the leaves. Keys and
    hashes are written once, so that no level computes ``fields`` again."""
    signed = [s.where(F.col(key).isNotNull()).select(key, _hash(key, fields).alias("h"), F.lit(sign).cast("bigint").alias("sign")) for s, sign in ((left, 1), (right, -1))]
    hashed = materialize(signed[0].unionByName(signed[1]), "diff-hashes")
    low, high = hashed.agg(F.min(key), F.max(key)).first()
    widths = [leaf_keys]
    while low is not None and high // widths[-1] - low // widths[-1] >= fanout:
        widths.append(widths[-1] * fanout)
    levels: list[DataFrame] = []
    for width in reversed(widths):
        inside = hashed.join(levels[-1], _range(key, width * fanout) == F.col("range"), "left_semi") if levels else hashed
        levels.append(materialize(_differing(inside, key, width), "diff-ranges"))
    return levels


def table_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str], *, left_name: str, right_name: str, leaf_keys: int = LEAF_KEYS, fanout: int = FANOUT) -> DataFrame:
    """``(key, issue)`` rows: ``missing_in_<name>`` for keys on one side only, else one row per differing field.

    ``key`` is integral; ``fields`` are already canonical (equal values compare equal, null means unknown and equals
    null). Repeated rows of a key that agree count once (a range where only their number differs is visited and gives no
    row); if copies of a key disagree, a field is reported when any pair of copies differs. Rows with a null key match
    nothing and are reported as missing on the other side, once for each distinct row. Empty tables are allowed; other
    columns are ignored, whatever their names. The checksums are computed while the plan is built.
    """
    keep = [key, *fields]
    left, right = left.select(*keep), right.select(*keep)
    bad = differing_ranges(left, right, key, fields, leaf_keys, fanout)[-1]

    def in_bad(side: DataFrame) -> DataFrame:
        inside = side.join(bad, _range(key, leaf_keys) == F.col("range"), "left_semi")
        return inside.distinct()

    l, r = in_bad(left).alias("l"), in_bad(right).alias("r")
    joined = l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    differing = [F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields]
    issues = (
        F.when(F.col(f"r.{key}").isNull(), F.array(F.lit(f"missing_in_{right_name}")))
        .when(F.col(f"l.{key}").isNull(), F.array(F.lit(f"missing_in_{left_name}")))
        .otherwise(F.array_compact(F.array(*differing)))
    )
    found = joined.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), F.explode(issues).alias("issue")).distinct()
    keyless = [
        side.where(F.col(key).isNull()).distinct().select(F.col(key), F.lit(f"missing_in_{other}").alias("issue"))
        for side, other in ((left, right_name), (right, left_name))
    ]
    return reduce(DataFrame.unionByName, keyless, found)
