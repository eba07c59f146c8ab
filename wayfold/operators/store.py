"""Reliable checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: rounds of a loop must not grow one plan. The session's shared folder is used; one is made only
    where none is set in local mode."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        root = sc.getConf().get("spark.checkpoint.dir", None)
        if not root and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="wayfold-"))
    return df.checkpoint()
