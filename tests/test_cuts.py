"""Cuts at shares of an ordered table against a plain rank."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadcast.operators import cuts
from roadcast.operators import validate as VA


@pytest.mark.parametrize("seed,ties", [(1, 1_000_000), (2, 1_000_000), (3, 2)])
def test_folds_equal_the_rank(spark, monkeypatch, seed, ties):
    monkeypatch.setattr(cuts, "TIES", ties)
    rng = random.Random(seed)
    rows = [(i, rng.choice(["u", "v", None]), rng.choice([0, 7, 7, 7, rng.randint(0, 50)])) for i in range(rng.randint(30, 90))]
    rng.shuffle(rows)
    shares = [("a", 0.3), ("b", 0.55), ("c", 0.9)]
    got = cuts.with_fold(spark.createDataFrame(rows, "id long, s string, t long"), "t", "id", F.floor(F.col("t") / 10), shares, "d", ["s"]).collect()
    expected = {}
    for s in ("u", "v", None):
        own = sorted((t, i) for i, x, t in rows if x == s)
        for k, (_, i) in enumerate(own, 1):
            expected[i] = next((n for n, x in shares if k <= math.floor(len(own) * x)), "d")
    assert {r["id"]: r["fold"] for r in got} == expected


def test_empty_and_tiny_tables(spark):
    df = spark.createDataFrame([(1, 5)], "id long, t long")
    assert [r["fold"] for r in cuts.with_fold(df, "t", "id", F.col("t"), [("a", 0.8)], "b").collect()] == ["b"]
    assert cuts.with_fold(df.limit(0), "t", "id", F.col("t"), [("a", 0.8)], "b").collect() == []


def test_no_row_is_exchanged_for_a_split(spark):
    df = spark.range(1000).select("id", F.timestamp_seconds(F.col("id") % 300).alias("start_datetime"))
    plan = VA.chrono_split(df, [("train", 0.7), ("validation", 0.85)], "test")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
