"""Where a plan is cut: what several steps read is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in ``spark.checkpoint.dir``; a local session without one gets a folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir() and sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def shared_path(df_or_spark, name: str) -> str:
    """A new folder's path in the shared folder of checkpoints, for tables that a study writes and reads again."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
