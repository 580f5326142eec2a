"""Durable intermediate tables and size-checked broadcasts.

Lineage is cut by writing Parquet into the folder that the cluster names in spark.checkpoint.dir: the files are shared, so a lost
executor costs nothing but its running tasks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. A local session without one gets a temporary folder; a cluster without one is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = d = tempfile.mkdtemp(prefix="lexiframe-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    return "file://" + _local[sc.applicationId]


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once and returns a reader of the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Deletes the files of a table made by durable() that no plan reads any more."""
    spark = df.sparkSession
    for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, p)


def _delete(spark: SparkSession, p: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has a path of the shared folder deleted when the application's driver ends: by Hadoop, whose file systems delete what they were
    told to when they are closed, also if the program fails."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    fs.create(p).close()  # a path must exist to be marked
    fs.deleteOnExit(p)
    fs.delete(p, True)


def drop_all(spark: SparkSession) -> None:
    """Deletes the session's durable tables now; results that read them must have been written."""
    for p in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, p)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if df has at most max_rows rows; stops counting beyond them."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if its row count was checked to be within max_rows, else df without one (a shuffle join)."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a parameter table, collected after a check of their number."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; it is a parameter table and must stay small")
    return rows
