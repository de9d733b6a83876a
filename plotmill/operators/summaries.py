"""Aggregations and ordered summaries of listing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breakdown(rows: DataFrame, label: Column, order: str) -> DataFrame:
    """Rows per label, with the labels' order of first appearance; null labels count as one label."""
    per = rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy("first", "label"))).select("label", "n", "rank")


def latest_by(rows: DataFrame, key: str, when: str, tie: str, keep: list[str]) -> DataFrame:
    """Per key the row of the latest time, the smallest ``tie`` among equals, and how many rows the key has."""
    best = F.min_by(F.struct(*keep), F.struct(F.datediff(F.lit("9999-12-31"), when), F.col(tie)))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("r"), F.count(F.lit(1)).alias("n")).select(key, "r.*", "n")


def until_stop(pages: DataFrame, group: str, order: str, stop: Column) -> DataFrame:
    """Pages up to and including the first one at which ``stop`` holds, per group."""
    first = pages.withColumn("__stop", F.when(stop, F.col(order))).groupBy(group).agg(F.min("__stop").alias("__at"))
    return pages.join(first, group).where(F.col("__at").isNull() | (F.col(order) <= F.col("__at"))).drop("__at")


def capped(rows: DataFrame, group: str, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows per group in a total order: the cap is the feature."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__k") <= cap).drop("__k")


def winners(rows: DataFrame, group: str, row_id: str, dimensions: dict[str, bool]) -> DataFrame:
    """Per group and dimension the best row (``True``: larger is better), the smallest id among equals; null is no value."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), (F.col(d) if up else -F.col(d)).cast("double").alias("v")) for d, up in dimensions.items()])
    long = rows.select(group, row_id, F.explode(cells).alias("c")).where("c.v is not null")
    best = F.max(F.struct(F.col("c.v"), -F.col(row_id))).alias("b")
    return long.groupBy(group, F.col("c.dimension").alias("dimension")).agg(best).select(group, "dimension", (-F.col("b.col2")).alias(row_id), F.abs("b.v").alias("value"))


def carried_sections(lines: DataFrame, group: str, order: str, marker: Column) -> DataFrame:
    """Each line with the last marker at or before it in its group. A group is one file, read in order."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(marker, ignorenulls=True).over(w))
