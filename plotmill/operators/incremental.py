"""Incremental forms: new rows against those already recorded, with explicit arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in ``order`` (a total order); rows with a null key are all kept."""
    firsts = rows.withColumn("__key", key)
    ordinal = F.struct(*order)
    first = firsts.where("__key is not null").groupBy("__key").agg(F.min_by(F.struct(*rows.columns), ordinal).alias("__row")).select("__row.*")
    return first.unionByName(firsts.where("__key is null").drop("__key"))


def unseen(rows: DataFrame, key: Column, seen: DataFrame, seen_key: Column, order: list[str]) -> DataFrame:
    """Rows whose key isn't among ``seen``, the first of each key. The hot key is one row after the first step."""
    keys = seen.select(seen_key.alias("__seen")).where("__seen is not null").distinct()
    return first_by_key(rows, key, order).withColumn("__key", key).join(keys, F.col("__key") == F.col("__seen"), "left_anti").drop("__key")


def carry_over(old: DataFrame, attempted: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys weren't attempted again, and all new rows."""
    return old.join(attempted.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_staged(staged: DataFrame, tracked: DataFrame, num: str, path: Column, tracked_path: Column, order: str) -> DataFrame:
    """Staged rows that enter the table: their number isn't there, nor their report; of several staged rows with one number
    or one report the first enters. Two phases, numbers before reports; a row refused for its number doesn't claim its
    report. Rows without a report are judged by number only; rows without a number don't enter."""
    by_num = unseen(staged.where(F.col(num).isNotNull()), F.col(num), tracked, F.col(num), [order])
    return unseen(by_num, F.nullif(path, F.lit("")), tracked, F.nullif(tracked_path, F.lit("")), [order])


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, bucket_days: int = 30) -> DataFrame:
    """Each left row with the ``value`` of the latest right row of its key at or before its time (null if there is none);
    of rows at one time the largest value counts. Rows without a key or time get null.

    No pairs: both sides are sorted together per key and bucket of time, and the last value of the earlier buckets is
    carried in, so a hot key is as many groups as its rows span buckets.
    """
    at = lambda c: F.col(c).cast("timestamp_ntz")
    slot = lambda c: F.floor(F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")) / bucket_days)
    kind = right.schema[value].dataType
    r = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull() & F.col(value).isNotNull()).select(F.col(key), slot(right_time).alias("__slot"), at(right_time).alias("__t"), F.col(value).alias("__v"))
    r = r.groupBy(key, "__slot", "__t").agg(F.max("__v").alias("__v"))
    l = left.withColumns({"__slot": slot(left_time), "__t": at(left_time)})
    slots = r.groupBy(key, "__slot").agg(F.max_by("__v", "__t").alias("__last")).unionByName(l.select(key, "__slot").distinct().withColumn("__last", F.lit(None).cast(kind)))
    earlier = Window.partitionBy(key).orderBy("__slot").rangeBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("__in", F.last("__last", ignorenulls=True).over(earlier)).where("__in is not null").groupBy(key, "__slot").agg(F.first("__in").alias("__in"))
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c != key]
    both = l.select(*left.columns, "__slot", "__t", F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__v")).unionByName(r.select(key, *blank, "__slot", "__t", F.lit(0).alias("__side"), "__v"))
    inner = Window.partitionBy(key, "__slot").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__v", ignorenulls=True).over(inner)).where("__side = 1")
    return seen.join(carried, [key, "__slot"], "left").select(*left.columns, F.coalesce("__seen", "__in").alias("as_of"))
