"""Writers (SC3, SC4, SC5, SC8, SC10).

* cleaned incidents are written partitioned by start date, so date-bounded
  reads prune whole folders;
* baselines are versions of :mod:`roadcast.sources.store`;
* the feedback log is appended only with outcomes that passed the
  ``left_anti`` key check, one folder per append (a retried append replaces
  its own folder);
* metric reports are a long table (run, model, label, metric, value).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcast.operators import feedback as FB


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark reads, sorted; none if it doesn't exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def write_clean(clean: DataFrame, path: str) -> None:
    """SC3: cleaned incidents, one folder per start date; the rows of a date are rebalanced first, so a date has few files."""
    (clean.withColumn("start_date", F.to_date("start_datetime_ist")).hint("rebalance", "start_date")
     .write.mode("overwrite").partitionBy("start_date").parquet(path))


def read_clean(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, dates: DataFrame | None = None) -> DataFrame:
    """SC2: cleaned incidents as written, with all types; only folders from ``first`` to ``last``, or of the ``dates``
    (``start_date``) of a table, are read. Rows without a start have a folder of their own, which no date asks for."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("start_date") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("start_date") <= F.lit(last).cast("date"))
    return rows if dates is None else rows.join(dates.select("start_date").distinct(), "start_date", "left_semi")


def write_dropped(dropped: DataFrame, path: str) -> None:
    """SC4: dropped-row log with reasons."""
    dropped.write.mode("overwrite").parquet(path)


def append_feedback(spark: SparkSession, new: DataFrame, log_path: str, batch_id: str) -> DataFrame:
    """SC8: append outcomes not yet logged (FB3); returns the accepted rows.

    A batch that is appended again is compared with the other batches only, and replaces its own folder. The log keeps
    each outcome's key, so only the new rows are hashed.
    """
    others = [name for name in children(spark, log_path) if name.startswith("batch=") and name != f"batch={batch_id}"]
    existing = spark.read.parquet(*[os.path.join(log_path, name) for name in others]) if others else None
    accepted = FB.accept(new, existing).select(*new.columns, "feedback_key")
    part = os.path.join(log_path, f"batch={batch_id}")
    accepted.write.mode("overwrite").parquet(part)
    return spark.read.parquet(part)


def metrics_long(run: str, model: str, wide: DataFrame, label: str = "all") -> DataFrame:
    """SC10: wide one-row metrics -> (run, model, label, metric, value)."""
    cols = [c for c, t in wide.dtypes if t in ("double", "bigint", "int", "float")]
    stack = ", ".join(f"'{c}', cast({c} as double)" for c in cols)
    return wide.select(F.lit(run).alias("run"), F.lit(model).alias("model"), F.lit(label).alias("label"),
                       F.expr(f"stack({len(cols)}, {stack}) as (metric, value)"))


def write_metrics(report: DataFrame, path: str) -> None:
    """SC10: a run that is written again replaces its own folder."""
    report.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run").parquet(path)
