"""Tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where the session
    names none and runs on one machine (tests) a temporary local one is made.
    On a cluster that names none this fails at once, not at a later read."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    own = "file://" + tempfile.mkdtemp(prefix="sitemill-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sitemill-{spark.sparkContext.applicationId}"


def own_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``clear`` removes."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, compression: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Writes ``df`` and reads it back: lineage ends there, nothing upstream
    runs twice, and a lost executor costs a reread. The tables of an
    application lie in one folder; ``clear`` removes it. ``options`` are the
    Parquet writer's."""
    spark = df.sparkSession
    path = own_path(spark, label)
    df.write.options(**(options or {})).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _remove(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` returned, once all that reads them has been
    written in its turn."""
    for table in tables:
        _remove(table.sparkSession, table.cut_path)


def free_shuffles(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that nothing refers to any
    more. It does so when the driver's garbage is collected, which on a driver
    with much memory may be long after a job has filled the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Removes all that this application has cut, once its results are used."""
    _remove(spark, _own_dir(spark))
