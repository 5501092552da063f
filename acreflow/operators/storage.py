"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the rows that may be broadcast; each row holds a few numbers and a key.
BROADCAST_ROWS = 100_000


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that all executors share.

    Where the setting is absent, as in tests, a folder of this machine is made;
    that is an error unless all tasks run on this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own.get(context.applicationId) or _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="acreflow-"))
    return folder.rstrip("/")


def _job_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/acreflow-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession) -> str:
    """A new name in the shared folder, for a table of this job."""
    return f"{_job_folder(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: this cuts the
    lineage, and the rows outlive lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written; results that read them must be written before."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_job_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only after the rows of a materialized table are counted."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
