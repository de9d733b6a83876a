"""Session helpers: table access and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import plotmill

# functions travel to the executors by value, so these need no copy of the package on their path
cloudpickle.register_pickle_by_value(plotmill)

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Only where it is unset and all executors are on this machine
    (tests, a laptop) a temporary folder is made and set as the session's checkpoint folder; on a cluster that is
    refused, as each executor would write to its own disk."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="plotmill-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


_WRITTEN: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing has used; it goes when the driver's program ends."""
    _WRITTEN.append(f"{shared_dir(spark)}/plotmill-{what}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


@atexit.register
def _tidy() -> None:
    """Remove what was written. Results are lazy and read these tables, so nothing can go before."""
    spark = SparkSession.getActiveSession()
    for path in _WRITTEN:
        local = path.removeprefix("file://") if path.startswith(("file:///", "/")) else None
        if local:
            shutil.rmtree(local, ignore_errors=True)
        elif spark is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, what: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation.
    This runs ``df`` at once, so operators that use it start jobs while their result is only being built."""
    spark = df.sparkSession
    path = new_path(spark, what)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
