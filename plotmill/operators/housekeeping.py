"""Keeping queues, histories and trackers in order: sections, retention, flags, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, PROCESSED = "Pending", "Processed"


def _done(line: Column) -> Column:
    """True for ticked lines, false for open ones, null for others."""
    return F.when(line.rlike("^\\s*- \\[[xX]\\]"), True).when(line.rlike("^\\s*- \\[ \\]"), False)


def section_hygiene(lines: DataFrame, section: str, line: str) -> DataFrame:
    """``lines`` with ``goes``: done lines go to the processed section and open ones back to the pending one, if they stand
    in either of them; lines of other sections, and lines that are no entries, stay. Null lines stay."""
    either = F.col(section).isin(PENDING, PROCESSED)
    goes = F.when(either & _done(F.col(line)), PROCESSED).when(either & ~_done(F.col(line)), PENDING).otherwise(F.col(section))
    return lines.withColumn("goes", goes)


def section_counts(lines: DataFrame, file: str, section: str, line: str) -> DataFrame:
    """Per file: entries pending, processed, and done but under pending. Lines that are no entries don't count."""
    entry, done = _done(F.col(line)).isNotNull(), _done(F.col(line))
    pending = F.col(section) == PENDING
    return lines.groupBy(file).agg(F.count_if(entry & pending).alias("pending"), F.count_if(entry & (F.col(section) == PROCESSED)).alias("processed"), F.count_if(pending & done).alias("done_pending"))


def retain(rows: DataFrame, history: DataFrame, url: str, today: Column, days: int) -> DataFrame:
    """``rows`` with ``since`` and ``goes``: ``archive`` when the history first saw the address more than ``days`` ago,
    ``keep`` when later, ``backfill`` when it doesn't know it; such a row counts from today and stays this time. Null
    addresses are unknown ones."""
    seen = history.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("__url")).agg(F.min("first_seen").alias("__since"))
    joined = rows.join(seen, F.col(url) == F.col("__url"), "left")
    goes = F.when(F.col("__since").isNull(), "backfill").when(F.datediff(today, "__since") > days, "archive").otherwise("keep")
    return joined.withColumn("goes", goes).withColumn("since", F.coalesce("__since", today)).drop("__url", "__since")


def compact(rows: DataFrame, droppable: Column, day: str, today: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """The rows that go to the archive of their month (column ``month``), and those that stay. Rows without a date stay."""
    old = F.coalesce(droppable & (F.datediff(today, day) > days), F.lit(False))
    return rows.where(old).withColumn("month", F.date_format(day, "yyyy-MM")), rows.where(~old)


def with_flags(rows: DataFrame, status: str, decided: tuple[str, ...], skipped: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``decided`` and ``skipped``; case and outer blanks of the status don't count, null is neither."""
    plain = F.lower(F.trim(status))
    flag = lambda names: F.coalesce(plain.isin(*[n.lower() for n in names]), F.lit(False))
    return rows.withColumn("decided", flag(decided)).withColumn("skipped", flag(skipped))


def coverage(covered: Column) -> Column:
    """Status of a run over its sources: 0 all covered, 1 some, 2 none, 3 there were no sources."""
    n, good = F.count(F.lit(1)), F.count_if(covered)
    return F.when(n == 0, 3).when(good == n, 0).when(good > 0, 1).otherwise(2)
