"""Query registry: name -> Spark job (spark, sf_dir) -> DataFrame, plus oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            return finalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def finalize(df: DataFrame) -> DataFrame:
    """Output timestamps as wall-clock NTZ values (UTC), matching naive SQL timestamps."""
    cols = []
    for name, dtype in df.dtypes:
        if dtype == "timestamp":
            cols.append(F.col(name).cast("timestamp_ntz").alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)
