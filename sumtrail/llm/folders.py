"""Where jobs keep intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which driver and executors share.

    Where the session doesn't name that folder (tests, one machine), it gets one.
    """
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None)
    if not base:
        base = tempfile.mkdtemp(prefix="sumtrail-")
        spark.conf.set(key, base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` after it was written to a shared folder and opened again.

    This cuts the lineage: a lost executor costs no more than the stage it worked on.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows that a task hands to Python at a time; long texts make large batches otherwise.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have this session hand rows to Python in batches that fit beside each other."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
