"""Shared inputs of the registered queries (all derived from the parquet tables).

The derived DataFrames are kept per (session, directory): a DataFrame is an
immutable plan, so reusing it saves re-analysing the same chain in every
query of a long-lived application.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from roadcast.operators import baseline, cleaning
from roadcast.operators.match import Baselines
from roadcast.operators.sizing import materialize
from roadcast.session import ensure_checkpoint_dir
from roadcast.sources import adapter
from roadcast.sources.store import BaselineStore, Version
from roadcast.sources.tables import table_path


@lru_cache(maxsize=64)
def _frame(session_key: int, sf_dir: str, name: str, spark: SparkSession) -> DataFrame:
    if name == "raw":
        return adapter.raw_incidents(spark, sf_dir)
    if name == "clean":
        return cleaning.clean_incidents(_frame(session_key, sf_dir, "raw", spark))
    if name == "incoming":
        return adapter.incoming(spark, sf_dir)
    if name == "feedback":
        return adapter.feedback_log(spark, sf_dir)
    raise KeyError(name)


def _get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = id(spark._jsparkSession)
    return _frame(key, sf_dir, name, spark)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _get(spark, sf_dir, "raw")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _get(spark, sf_dir, "clean")


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _get(spark, sf_dir, "incoming")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _get(spark, sf_dir, "feedback")


@lru_cache(maxsize=64)
def _published(session_key: int, sf_dir: str, state_of_table: str, spark: SparkSession) -> BaselineStore:
    """The store of a table's baselines, with a first version built from all its incidents."""
    store = BaselineStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/baselines-{uuid.uuid4().hex}")
    state = materialize(baseline.value_counts(clean(spark, sf_dir)), "value-counts")
    store.publish(baseline.grains_of(state), state, note=f"{sf_dir} {state_of_table}")
    return store


def stored_version(spark: SparkSession, sf_dir: str) -> Version:
    """The newest stored baseline of the incidents in ``sf_dir``; a table whose files changed gets a store of its own."""
    where = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, "events"))
    sums = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where)
    state = f"{sums.getLength()} bytes in {sums.getFileCount()} files, {where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()}"
    return _published(id(spark._jsparkSession), sf_dir, state, spark).read()


def baselines(spark: SparkSession, sf_dir: str) -> Baselines:
    """The stored tiers that forecasts join."""
    return stored_version(spark, sf_dir).tiers
