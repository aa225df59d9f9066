"""Helpers that the operators share: reading tables and cutting lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcast.session import ensure_checkpoint_dir

#: White space and words as the contracts define them (Java, Python and RE2 syntax alike).
SPACED_WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a Python step gets at once: of texts or sets, which take kilobytes each, and of some numbers.
ARROW_ROWS, WIDE_ROWS, NARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read back; ``options`` are the writer's.

    The written table survives the loss of any executor, carries size
    statistics (so that Spark itself decides whether a later join may
    broadcast it), and puts a plain exchange below such a join, whose skewed
    partitions adaptive execution can then split.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python steps that start inside get at most ``rows`` rows at once, on the JVM's side as on Python's."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns in one struct, _row, so that computed columns can't clash with any of its names."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")
