"""Cutting lineage, and broadcasts that depend on a measured size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpoint_dir(spark) -> str:
    """The shared folder the cluster names; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-lithoframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and continue from the written table.

    Survives the loss of executors, is computed once, and gives the planner the true size.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._is_cut = True
    return written


def sized(df: DataFrame) -> DataFrame:
    """A derived table about to be joined to a large one.

    Written out, its size is known from its files: the planner broadcasts it below
    spark.sql.autoBroadcastJoinThreshold and shuffles it otherwise. Without this a small aggregate
    carries a size estimate as large as its input. A table that is already written is kept.
    """
    return df if getattr(df, "_is_cut", False) else cut(df)
