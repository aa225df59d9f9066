"""Cutting lineage with written tables.

A side table is written to the cluster's shared folder and read back. The
files survive executor loss, and their size is what Spark's planner sees: it
broadcasts a side under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
sort-merges, where both sides are then plain exchanges whose skewed
partitions adaptive execution can split. No row count, no hint, and each side
is decided by its own bytes.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from roadcast.session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read back (never a local checkpoint)."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A side table of known size: the planner broadcasts it if its bytes are few."""
    return materialize(df, "side")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan of some splits in at least as many partitions as tasks can run at once; a table of one split is small and keeps its order."""
    slots, now = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if now >= slots or now < 2 else df.repartition(slots, *keys)
