"""Rank and running sums over a huge ordered partition, in two levels.

``row_number()`` / ``sum() over (order by ...)`` with one giant (or no)
``partitionBy`` key runs in a single task. This operator computes the same
values with balanced tasks:

1. the rows are written once, and only their narrow part (keys, order columns,
   summed columns and a row number) goes on; its counted rows and its bytes
   give the number of ranges, RANGE_ROWS and RANGE_BYTES at most in each;
2. range-partition on (partition keys, order keys) - the order must end in a
   unique key, so the sampled boundaries split even a single hot partition
   key; the result is written so every later read sees the same ranges;
3. per (range, key): row count and column sums - a table of at most
   (ranges + keys) rows; offsets are running totals over earlier ranges;
4. rank / prefix sums inside each (range, key) slice plus its offset, joined
   to the other columns by the row number, where there are any.

Order columns are named ("score desc", "id"); given as expressions, all columns
go through the ranges. One strategy at every size; equal to the single-window
result (checked by the tests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadcast.operators.sizing import materialize

RANGE_ROWS, RANGE_BYTES = 2_000_000, 128 << 20


def _c(c) -> Column:
    if not isinstance(c, str):
        return c
    name, _, way = c.partition(" ")
    return F.col(name).desc() if way == "desc" else F.col(name).asc()


def ranges_for(narrow: DataFrame, rows: int) -> int:
    """Number of ranges by counted rows and the planner's bytes (column widths and file sizes)."""
    planned = int(str(narrow._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, -(-rows // RANGE_ROWS), -(-planned // RANGE_BYTES))


def rank_rows(df: DataFrame, partition_cols: list[str], order_cols: list, sum_cols: list[str] = (),
              rank_col: str = "rank", before_prefix: str = "before_", n_ranges: int | None = None) -> DataFrame:
    """Add 1-based ``rank_col`` and exclusive prefix sums ``before_<c>`` per partition; null keys are a partition too."""
    keys = list(partition_cols)
    order = [_c(c) for c in order_cols]
    named = all(isinstance(c, str) for c in order_cols)
    needed = [*dict.fromkeys([*keys, *(c.partition(" ")[0] for c in order_cols), *sum_cols])] if named else df.columns
    others = [c for c in df.columns if c not in needed]
    # written: the row numbers must stay what they are, and sampling the boundaries is a job of its own
    src = materialize(df.withColumn("_row", F.monotonically_increasing_id()) if others else df, "rank-rows")
    narrow = src.select(*needed, *(["_row"] if others else []))
    n = n_ranges or ranges_for(narrow, src.count())
    r = materialize(narrow.repartitionByRange(n, *[F.col(k) for k in keys], *order)
                    .withColumn("_rp", F.spark_partition_id()), "ranges")
    tot = r.groupBy("_rp", *keys).agg(F.count(F.lit(1)).alias("_n"),
                                      *[F.sum(c).alias(f"_s_{c}") for c in sum_cols])
    earlier = Window.partitionBy(*keys).orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    offs = materialize(tot.select(
        F.col("_rp").alias("_o_rp"), *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sum_cols]), "offsets")
    same = r["_rp"] == offs["_o_rp"]
    for k in keys:
        same = same & r[k].eqNullSafe(offs[f"_o_{k}"])
    inner = Window.partitionBy("_rp", *keys).orderBy(*order)
    inner_prev = inner.rowsBetween(Window.unboundedPreceding, -1)
    out = r.join(offs, same).withColumns({
        rank_col: F.col("_off_n") + F.row_number().over(inner),
        **{f"{before_prefix}{c}": F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(inner_prev), F.lit(0))
           for c in sum_cols},
    })
    added = [rank_col, *(f"{before_prefix}{c}" for c in sum_cols)]
    if not others:
        return out.select(*df.columns, *added)
    return src.join(out.select("_row", *added), "_row").select(*df.columns, *added)


def window_rank(df: DataFrame, partition_cols: list[str], order_cols: list,
                sum_cols: list[str] = (), rank_col: str = "rank", before_prefix: str = "before_") -> DataFrame:
    """Single-window form: what the tests compare with."""
    w = Window.partitionBy(*partition_cols).orderBy(*[_c(c) for c in order_cols])
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({
        rank_col: F.row_number().over(w),
        **{f"{before_prefix}{c}": F.coalesce(F.sum(c).over(prev), F.lit(0)) for c in sum_cols},
    })
