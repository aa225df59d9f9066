"""Exact cuts of an ordered table at shares of its rows, without ranking it (VA1, VA2, EX10).

``row_number() <= floor(n * share)`` needs the rank of every row; the cut needs one row: the last one inside. It is
found by counting, level by level, on a narrow table of the order keys:

1. rows per coarse bucket of the first key: the bucket that holds the wanted position;
2. rows per value of the first key inside that bucket: the value that holds it;
3. rows of that value, in order of the second key: the boundary (first key, second key).

Each row then belongs to a fold by comparison with the boundaries, one row a stratum, in the scan that reads it: no
row is exchanged, ranked or written for the cut. Ties are exact, as the boundary has the unique second key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadcast.operators.ranking import rank_rows
from roadcast.operators.sizing import materialize

#: Rows of one value of the first key that one task may put in order; beyond, they are ranked in ranges.
TIES = 1_000_000


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs], F.lit(True))


def _holding(counted: DataFrame, groups: list[str], key: str) -> DataFrame:
    """Rows of ``counted`` (groups, key, n, k) whose running count reaches k; k then counts inside that row."""
    running = Window.partitionBy(*groups).orderBy(key)
    rows = counted.withColumn("_to", F.sum("n").over(running))
    return rows.where((F.col("_to") >= F.col("k")) & (F.col("_to") - F.col("n") < F.col("k"))).withColumn("k", F.col("k") - F.col("_to") + F.col("n")).drop("_to")


def boundaries(df: DataFrame, first: str, second: str, bucket: Column, shares: list[float], strata: list[str] = ()) -> DataFrame:
    """(strata as _s0.., n, cut0.., one struct(first, second) a share; null if no row is inside): a row for each stratum."""
    s = [f"_s{i}" for i in range(len(strata))]
    keys = materialize(df.select(*(F.col(c).alias(a) for c, a in zip(strata, s)), F.col(first).alias("_1"), F.col(second).alias("_2"),
                                 bucket.alias("_b")), "order-keys")
    hist = keys.groupBy(*s, "_b").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col("total") * F.lit(x)).cast("long").alias("k")) for i, x in enumerate(shares)))
    asked = hist.withColumn("total", F.sum("n").over(Window.partitionBy(*s)))
    asked = asked.select(*s, "_b", "n", F.explode(wanted).alias("w")).select(*s, "_b", "n", "w.i", "w.k")
    target = materialize(_holding(asked, [*s, "i"], "_b"), "cut-buckets").withColumnsRenamed({c: f"t{c}" for c in [*s, "_b"]})
    inside = keys.join(F.broadcast(target.drop("n")), _same(keys, target, [(c, f"t{c}") for c in [*s, "_b"]]))
    values = inside.groupBy(*s, "i", "k", "_1").agg(F.count(F.lit(1)).alias("n"))
    value = materialize(_holding(values, [*s, "i"], "_1"), "cut-values").withColumnsRenamed({c: f"t{c}" for c in [*s, "_1"]})
    tied = keys.join(F.broadcast(value.drop("n")), _same(keys, value, [(c, f"t{c}") for c in [*s, "_1"]])).select(*s, "i", "k", "_1", "_2")
    if (value.agg(F.max("n")).first()[0] or 0) > TIES:
        tied = rank_rows(tied, [*s, "i"], ["_2"], rank_col="_at")
    else:
        tied = tied.withColumn("_at", F.row_number().over(Window.partitionBy(*s, "i").orderBy("_2")))
    found = tied.where(F.col("_at") == F.col("k"))
    cuts = found.groupBy(*s).agg(*(F.max(F.when(F.col("i") == i, F.struct("_1", "_2"))).alias(f"cut{i}") for i in range(len(shares))))
    sizes = hist.groupBy(*s).agg(F.sum("n").alias("_rows")).withColumnsRenamed({c: f"r{c}" for c in s})
    out = sizes.join(cuts, _same(sizes, cuts, [(f"r{c}", c) for c in s]), "left") if s else sizes.crossJoin(F.broadcast(cuts))  # one row each
    return materialize(out.select(*(F.col(f"r{c}").alias(c) for c in s), "_rows", *(f"cut{i}" for i in range(len(shares)))), "cuts")


def with_fold(df: DataFrame, first: str, second: str, bucket: Column, folds: list[tuple[str, float]], last: str, strata: list[str] = ()) -> DataFrame:
    """``df`` with ``fold``: the first name whose share holds the row's place in order of (first, second), else ``last``."""
    cuts = boundaries(df, first, second, bucket, [x for _, x in folds], strata)
    s = [f"_s{i}" for i in range(len(strata))]
    on = _same(df, cuts, list(zip(strata, s))) if s else F.lit(True)
    rows = df.join(F.broadcast(cuts), on, "left") if s else df.crossJoin(F.broadcast(cuts))  # one row for each stratum
    place = F.struct(F.col(first).alias("_1"), F.col(second).alias("_2"))
    fold = None
    for i, (name, _) in enumerate(folds):
        inside = place <= F.col(f"cut{i}")
        fold = F.when(inside, F.lit(name)) if fold is None else fold.when(inside, F.lit(name))
    return rows.withColumn("fold", fold.otherwise(F.lit(last))).drop(*s, "_rows", *(f"cut{i}" for i in range(len(folds))))
