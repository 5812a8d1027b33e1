"""Cutting a plan's lineage with a checkpoint in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint, which outlives any executor. Only where all run on one machine may the folder be unset."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(f"{tempfile.gettempdir()}/tidelines-shared/checkpoints")
    return df.checkpoint()
