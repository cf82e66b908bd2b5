"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder that driver and executors share (spark.checkpoint.dir; a temporary one only where
    it is unset and the master is local), so that lost executors lose nothing."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vigilspark-"))
    return df.checkpoint(eager=True)
