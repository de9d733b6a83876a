"""References to records that do not exist, from signed counts per key.

The ledger counts, per (referring table, key, date), how many references and how many existing records there are. It is
the sum of signed change deltas: +1 for a reference or record that comes, -1 for one that goes. A date stays in it as
long as its counts aren't 0, so the earliest dates of a key move back when a row is withdrawn. Batches of deltas are
summed and appended; reading adds them up, and compaction replaces them by their sum, so no batch looks at old rows.
Keys with references and no existing record are the current orphans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.runtime import new_path

KEYS = ("ref_table", "key")
_COUNTS = ("refs", "live", "ever")
_SCHEMA = "ref_table string, key string, on date, refs bigint, live bigint, ever bigint"


def _delta(df: DataFrame, table: str, key: Column, on: Column, keep: tuple[str, ...], **counts: int) -> DataFrame:
    return df.select(*keep, F.lit(table).alias("ref_table"), key.cast("string").alias("key"), on.cast("date").alias("on"), *[F.lit(counts.get(c, 0)).cast("bigint").alias(c) for c in _COUNTS]).where(F.col("key").isNotNull())


def reference_deltas(rows: DataFrame, table: str, key: Column, on: Column, sign: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """+1 (or, for withdrawn rows, -1) reference per row; rows without a key give none. ``keep``: columns that stay."""
    return _delta(rows, table, key, on, keep, refs=sign)


def existence_deltas(rows: DataFrame, table: str, key: Column, since: Column, sign: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """+1 existing record per row that was created, or -1 if its creation is withdrawn, as if it had never been;
    ``table`` is the table that refers to these records."""
    return _delta(rows, table, key, since, keep, live=sign, ever=sign)


def deletion_deltas(rows: DataFrame, table: str, key: Column, since: Column, sign: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """-1 existing record per row that was deleted (+1 if the deletion is withdrawn). ``since`` is the date of the
    record's creation, as in ``existence_deltas``; that it once existed stays counted."""
    return _delta(rows, table, key, since, keep, live=-sign)


def fold(*deltas: DataFrame) -> DataFrame:
    """The ledger: sums of the deltas, without what has become 0. An earlier ledger may be among them. Sums are combined
    before the shuffle, so a key that holds a third of all rows sends one row per date and task."""
    sums = reduce(DataFrame.unionByName, deltas).groupBy(*KEYS, "on").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return sums.where(" or ".join(f"{c} <> 0" for c in _COUNTS))


class ReferenceLedger:
    """A ledger kept in a folder: ``apply`` appends the sums of a batch of deltas, ``current`` adds up what is there.

    ``path`` may hold an earlier ledger, which goes on; without one a new folder below the shared one is used. An empty
    batch changes nothing. Batches must be applied once each and one at a time."""

    #: Appended batches after which they are replaced by their sum.
    COMPACT_AFTER = 24

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def _parts(self) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = {s.getPath().getName() for s in fs.listStatus(at) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))}
        # a sum replaces all batches up to its number, also if a crash left them in place
        last = max((n for n in names if n.startswith("sum-")), default="")
        return sorted((n for n in names if n == last or n.startswith("add-") and n[4:] > last[4:]), key=lambda n: n[4:])

    def _write(self, deltas: DataFrame, name: str) -> None:
        fold(deltas).write.option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/{name}")

    def apply(self, deltas: DataFrame) -> None:
        parts = self._parts()
        number = int(parts[-1][4:]) + 1 if parts else 1
        self._write(deltas, f"add-{number:09d}")
        if len(parts) >= self.COMPACT_AFTER:
            self._write(self.current(), f"sum-{number:09d}")
            fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for old in [*parts, f"add-{number:09d}"]:
                fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)

    def current(self) -> DataFrame:
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], _SCHEMA)
        return fold(self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{p}" for p in parts]))


def key_states(ledger: DataFrame) -> DataFrame:
    """One row per key: its counts, the first date of a record (``since``) and of a reference (``ref_since``)."""
    first = lambda c: F.min(F.when(F.col(c) > 0, F.col("on")))
    return ledger.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in _COUNTS], first("ever").alias("since"), first("refs").alias("ref_since"))


def orphan_keys(ledger: DataFrame) -> DataFrame:
    """Keys with positive references and no existing record."""
    return key_states(ledger).where((F.col("refs") > 0) & (F.col("live") <= 0))


def suspects(ledger: DataFrame) -> DataFrame:
    """Keys with positive references that exist nowhere, or exist only from after their first reference on."""
    return key_states(ledger).where((F.col("refs") > 0) & ((F.col("live") <= 0) | (F.col("ref_since") < F.col("since"))))


def orphan_rows(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """The referring rows whose target is ``missing``, ``deleted`` or ``late``, with the month of the reference.

    ``rows`` has ``ref_table``, ``ref_id``, ``key`` and ``ref_on``. A null date is never late and has a null month. Rows
    without a key are no references. Sound keys are dropped from the ledger before the join, so hot sound keys join
    nothing; a hot orphan key is one row on the ledger's side, and the rows' side is split by adaptive execution.
    """
    bad = suspects(ledger).select(*KEYS, "live", "ever", "since")
    reason = F.when(F.col("ever") <= 0, "missing").when(F.col("live") <= 0, "deleted").when(F.col("ref_on") < F.col("since"), "late")
    return (
        rows.where(F.col("key").isNotNull())
        .join(bad, list(KEYS))
        .select("ref_table", "ref_id", reason.alias("reason"), F.date_format("ref_on", "yyyy-MM").alias("ref_month"))
        .where(F.col("reason").isNotNull())
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, month and reason."""
    return orphans.groupBy("ref_table", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_refs"))
