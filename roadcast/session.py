"""Spark session helpers.

The engine relies on: UTC session zone (timestamps are UTC instants, IST is
derived explicitly), adaptive execution (runtime coalescing and skew-join
splitting), and a reliable checkpoint directory for cutting lineage. On a
cluster the checkpoint directory comes from ``spark.checkpoint.dir``; a local
temporary folder is only used when nothing is configured and the master is
local (tests, laptops), and is an error on a cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Fine baselines have hundreds to thousands of groups per task; keep the
    # object-hash aggregate (mode) in hash mode instead of falling back to sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # The JVM never compiles a method of more than 8,000 bytes: a stage whose generated loop is longer (the advisory with
    # all its columns) runs several times slower than the same operators one by one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark's own value, for queries after the corpus pipeline, whose stages set a smaller one.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}

#: The training-data operators keep Spark's own limit: they were measured with it.
CORPUS_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "65535"}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "roadcast") -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.ui.enabled", "false")
    # checkpoint files of DataFrames that went out of scope are removed
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_session_settings(spark)
    return spark


def apply_session_settings(spark: SparkSession, own: dict[str, str] | None = None) -> None:
    """Apply the runtime-settable defaults, and what a query has in place of them, to an existing session."""
    for k, v in {**SESSION_DEFAULTS, **(own or {})}.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave as is
            pass
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    Order: an already-set SparkContext checkpoint dir, then the cluster's
    ``spark.checkpoint.dir`` setting, and only when both are unset a fresh
    local temporary folder (local mode / tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="roadcast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
