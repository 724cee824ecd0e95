"""Tables written into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local sessions without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return base


def written(df: DataFrame) -> DataFrame:
    """df written once as a table into the shared folder and read back: computed once, sizes known, lineage cut."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_files_of(rows: int, df: DataFrame) -> DataFrame:
    """As :func:`written`, for rows of megabytes: in files of so few that a reader, which takes thousands of rows of a file
    at a time, holds few."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What a batch sent to a Python worker holds at most, unless the session sets limits of its own: a worker keeps a few
# copies of a batch, and texts can be long.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bounded(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches bounded by BATCH_LIMITS where neither the session nor its start-up configuration
    sets them. They stay set, as df may be evaluated at any time."""
    conf = df.sparkSession.conf
    given = conf.getAll
    for key, most in BATCH_LIMITS.items():
        if key not in given:
            conf.set(key, most)
    return df
