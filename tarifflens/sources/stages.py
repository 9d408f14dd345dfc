"""Intermediate results that several later steps read, stored where every executor can reach them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The frame, computed once and cut from its lineage by a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``; only local mode makes up one of its own where that is unset.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = tempfile.mkdtemp(prefix="stages-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
