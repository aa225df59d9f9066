"""Exact, interpolated median per group without a whole group in one task.

Spark's ``median`` keeps a value->count map per group and merges the maps of
all tasks in one place, so a cause holding a third of a 100 TB history would
have its whole distinct-value map in a single task. This operator finds the
same exact median with bounded per-task state:

1. count rows per (group, value)   - partial aggregation; a hot group is
                                     spread over its distinct values
2. count rows per (group, bucket)  - bucket = whole minutes, a small table
3. running count over the buckets of each group -> the bucket(s) holding the
   middle rank(s) ``floor((n-1)/2)`` and ``floor(n/2)``
4. only the (at most two) target buckets per group are re-read from step 1
   and ranked by value; the two middle values are interpolated like
   ``percentile(0.5)``: ``lo + (hi - lo) * 0.5``.

Keys may contain nulls (grain-tagged baselines); every join is null-safe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def grouped_exact_median(df: DataFrame, keys: list[str], value: str,
                         out: str = "median", bucket_width: float = 1.0,
                         weight: str | None = None) -> DataFrame:
    """Return ``keys + [out]`` with one row per group having a non-null value.

    ``weight`` names a row-multiplicity column when ``df`` is already counted
    (e.g. the output of a grouping-sets aggregate).
    """
    w = F.col(weight) if weight else F.lit(1)
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), w.alias("_w"))
    vc = v.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c"))
    vc = vc.withColumn("_b", F.floor(F.col("_v") / F.lit(float(bucket_width))))

    buckets = vc.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    wg = Window.partitionBy(*keys)
    wrun = wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumns({"_n": F.sum("_bc").over(wg), "_hi": F.sum("_bc").over(wrun)})
    buckets = buckets.withColumns({
        "_lo": F.col("_hi") - F.col("_bc"),
        "_r1": F.floor((F.col("_n") - 1) / 2),
        "_r2": F.floor(F.col("_n") / 2),
    })
    in_bucket = lambda r: (F.col(r) >= F.col("_lo")) & (F.col(r) < F.col("_hi"))
    targets = buckets.where(in_bucket("_r1") | in_bucket("_r2")).select(
        *[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_b").alias("_tb"),
        "_lo", "_r1", "_r2")

    t_keys = {k: f"_t_{k}" for k in keys}
    cond = reduce(lambda a, b: a & b,
                  [vc[k].eqNullSafe(targets[t]) for k, t in t_keys.items()]) & (vc["_b"] == targets["_tb"])
    cand = vc.join(targets, cond, "inner").drop(*t_keys.values(), "_tb")

    wb = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cand = cand.withColumn("_cum", F.col("_lo") + F.sum("_c").over(wb))
    cand = cand.withColumn("_start", F.col("_cum") - F.col("_c"))
    at = lambda r: (F.col(r) >= F.col("_start")) & (F.col(r) < F.col("_cum"))
    res = cand.groupBy(*keys).agg(F.max(F.when(at("_r1"), F.col("_v"))).alias("_m1"),
                                  F.max(F.when(at("_r2"), F.col("_v"))).alias("_m2"))
    return res.select(*keys, ((F.col("_m1") + F.col("_m2")) / F.lit(2.0)).alias(out))
