"""Reading tables, cutting lineage and instants: shared by the operators of this package."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Intermediate tables written so far, by application: they go when the session ends, or when `clear` is called.
_WRITTEN: dict[str, list[str]] = {}
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. A session of one machine that names none gets its own; a cluster must name one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: lineage is cut by tables written there")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="scriptorium-")
    return _OWN[app]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, an executor's loss costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scriptorium-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this session; results read from them must have been written before."""
    gone = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in gone:
        fs, p = _path(spark, path)
        fs.delete(p, True)
    return len(gone)


def release(spark: SparkSession) -> None:
    """Lets the driver drop what finished jobs held: plans, and with them broadcasts and shuffle files, stay until its
    collector finds them, and its memory grows with each phase of a long query otherwise."""
    gc.collect()  # Python's handles of plans first
    spark.sparkContext._jvm.System.gc()


def instant(text: Column) -> Column:
    """ISO-8601 text with an offset as a timestamp; NULL, empty or unreadable text is NULL."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))
