"""Flat files: history and reports as read and written by the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.functions.text import tsv_field

HISTORY = "url string, first_seen string, portal string, title string, location string, price string, m2 string, rooms string, status string"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History lines, with or without a header line; numbers that are none are null, short lines keep what they have."""
    raw = spark.read.csv(path, sep="\t", schema=HISTORY, quote="", mode="PERMISSIVE")
    typed = [F.col(c).try_cast(t).alias(c) for c, t in (("first_seen", "date"), ("price", "double"), ("m2", "double"), ("rooms", "double"))]
    return raw.where("url is null or url <> 'url'").select("url", typed[0], "portal", "title", "location", *typed[1:], "status")


def append_history(rows: DataFrame, path: str) -> None:
    """Append rows as tab-separated lines; unknown numbers (null, 0) are empty, tabs and line ends in texts blanks."""
    number = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c).cast("string")), F.lit(""))
    line = F.concat_ws("\t", tsv_field(F.col("url")), F.coalesce(F.col("first_seen").cast("string"), F.lit("")), *[tsv_field(F.col(c)) for c in ("portal", "title", "location")], *map(number, ("price", "m2", "rooms")), tsv_field(F.col("status")))
    rows.select(line.alias("value")).write.mode("append").text(path)


def append_archive(rows: DataFrame, path: str, day: str = "first_seen") -> None:
    """Append rows to an archive partitioned by month."""
    rows.withColumn("month", F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))).write.mode("append").partitionBy("month").parquet(path)


def read_documents(spark: SparkSession, glob: str) -> DataFrame:
    """Whole text files with the name they were read from."""
    return spark.read.text(glob, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"), F.col("value").alias("text"))


def read_updates(spark: SparkSession, glob: str) -> DataFrame:
    """Staged updates, one row per note: ``url, line, num, status, append``; files that are no JSON give no row."""
    schema = "url string, line string, tracker_notes array<struct<num:string,status:string,append:string>>"
    d = spark.read.text(glob, wholetext=True).select(F.from_json("value", schema).alias("u")).where("u.url is not null")
    return d.select("u.url", "u.line", F.explode_outer("u.tracker_notes").alias("n")).select("url", "line", F.regexp_replace("n.num", "^0+(?=[0-9])", "").alias("num"), "n.status", "n.append")
