"""Intermediate results that iterations read again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-saved-")


def new_path(spark: SparkSession) -> str:
    """A path below spark.checkpoint.dir that nothing has yet; only local sessions may leave that unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/traceflow-saved/{uuid.uuid4().hex}"


def saved(df: DataFrame, files: int | None = None) -> DataFrame:
    """df written below spark.checkpoint.dir and read again, which cuts its lineage. files: so many, where df is small."""
    spark = df.sparkSession
    path = new_path(spark)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.saved_at = path
    return got


def discard(df: DataFrame | None) -> None:
    """Deletes what `saved` wrote for df; nothing that isn't saved yet may read it."""
    path = getattr(df, "saved_at", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
