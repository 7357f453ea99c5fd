"""Results that several later steps read, kept in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir; where none is set, a folder of this machine in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "tracewell-checkpoints"))


def stored(df: DataFrame) -> DataFrame:
    """df from the checkpoint folder, computed once, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a stored table goes to every task of a join.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df
