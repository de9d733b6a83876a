"""Streams of listings and events. Every function takes a streaming or a batch DataFrame unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotmill.functions.text import canonical_url
from plotmill.operators.incremental import unseen
from plotmill.runtime import new_path


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a parquet file or folder, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def tumbling(events: DataFrame, time: str, width: str, by: list[str], aggs: list[Column], late: str = "1 day") -> DataFrame:
    """Aggregates per window of fixed width; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*aggs)


def sliding(events: DataFrame, time: str, width: str, slide: str, by: list[str], aggs: list[Column], late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(*aggs)


def sessions(events: DataFrame, time: str, gap: str, by: list[str], aggs: list[Column], late: str = "1 day") -> DataFrame:
    """Aggregates per session: rows less than ``gap`` apart."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(*aggs)


def first_adverts(listings: DataFrame, time: str, late: str) -> DataFrame:
    """The first row of each canonical address within the watermark; the state is bounded by it."""
    return listings.withColumn("canonical", canonical_url(F.col("url"))).withWatermark(time, late).dropDuplicatesWithinWatermark(["canonical"])


def ingest_into(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch handler that appends the rows whose canonical address the table at ``path`` hasn't got: unbounded memory
    of what was seen, in the table instead of the stream's state. Writing a batch twice appends nothing the second time."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
        seen = spark.read.schema(batch.schema).parquet(path) if there else batch.limit(0)
        key = canonical_url(F.col("url"))
        unseen(batch, key, seen, key, order).write.mode("append").parquet(path)

    return handle


def run_available(stream: DataFrame, mode: str = "append", handler: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream over what is there now, and return what it wrote (None with a handler)."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True)
    out = new_path(spark, "stream-out")
    if handler:
        query: StreamingQuery = writer.foreachBatch(handler).start()
    elif mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        # complete results replace each other; the last batch's are left
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return None if handler else spark.read.schema(stream.schema).parquet(out)
