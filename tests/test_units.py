"""Boundary values, the exact median, the two-level rank and the sign-board extraction."""

import random

import pytest
from pyspark.sql import functions as F

from roadcast.functions import expressions as X
from roadcast.operators import deploy as DP
from roadcast.operators.median import grouped_exact_median
from roadcast.operators import ranking as R
from roadcast.operators.ranking import rank_rows, window_rank
from roadcast.operators.sizing import materialize


def one(spark, expr, value, dtype):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v"))).collect()[0][0]


@pytest.mark.parametrize("minutes,tier", [(49.99, "Low"), (50.0, "Medium"), (119.99, "Medium"), (120.0, "High"),
                                          (None, "Unknown")])
def test_duration_cuts(spark, minutes, tier):
    assert one(spark, X.severity_by_duration, minutes, "double") == tier


@pytest.mark.parametrize("hour,band", [(0, "night"), (5, "night"), (6, "morning"), (11, "morning"), (12, "afternoon"),
                                       (17, "afternoon"), (18, "evening"), (23, "evening"), (99, "evening")])
def test_hour_bands(spark, hour, band):
    assert one(spark, X.hour_bucket, hour, "int") == band


@pytest.mark.parametrize("score,tier", [(0.3499, "Low"), (0.35, "Medium"), (0.6499, "Medium"), (0.65, "High"),
                                        (1.0, "High"), (1.01, "Unknown")])
def test_score_cuts(spark, score, tier):
    assert one(spark, X.severity_by_score, score, "double") == tier


@pytest.mark.parametrize("tier,prob,flag,n,barricade", [
    ("Low", 0.39, False, 2, True), ("Low", 0.40, False, 4, True), ("Low", 0.24, None, 2, False),
    ("Low", 0.25, False, 2, True), ("High", 0.9, True, 10, True), ("Unknown", None, True, 6, True),
    ("Medium", None, False, 4, True), ("Unknown", None, None, 4, False)])
def test_personnel_and_barricade(spark, tier, prob, flag, n, barricade):
    df = spark.createDataFrame([(tier, prob, flag)], "t string, p double, f boolean")
    r = df.select(X.personnel(F.col("t"), F.col("p"), F.col("f")).alias("n"),
                  X.barricade(F.col("t"), F.col("p"), F.col("f")).alias("b")).collect()[0]
    assert (r["n"], r["b"]) == (n, barricade)


def test_bump(spark):
    df = spark.createDataFrame([("Low", True), ("Medium", True), ("High", True), ("Unknown", True), ("Low", None)],
                               "t string, f boolean")
    got = [r[0] for r in df.select(X.apply_bump(F.col("t"), F.col("f"))).collect()]
    assert got == ["Medium", "High", "High", "Unknown", "Low"]


def test_np_round_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (77.225,)], "v double")
    assert [r[0] for r in df.select(X.np_round(F.col("v"), 2)).collect()] == [0.12, 0.14, 77.22]


def test_exact_median_matches_builtin(spark):
    rnd = random.Random(3)
    rows = [("hot", float(rnd.randint(0, 3000)) / 7) for _ in range(3000)]
    rows += [(f"g{i % 9}", rnd.random() * 500) for i in range(400)] + [("single", 5.5), ("pair", 1.0), ("pair", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in grouped_exact_median(df, ["k"], "v").collect()}
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("ranges", [1, 2, 6, 40])
def test_rank_rows_equals_window(spark, ranges):
    """Hot, single-row and null partition keys."""
    rnd = random.Random(5)
    rows = [("big" if i % 3 else None if i % 2 else f"q{i % 7}", rnd.randint(0, 50), i, rnd.randint(0, 9)) for i in range(2000)] + [("one", 1, 9000, 3)]
    df = spark.createDataFrame(rows, "q string, score int, idx long, req int")
    order = [F.col("score").desc(), F.col("idx").asc()]
    a = rank_rows(df, ["q"], order, ["req"], n_ranges=ranges).select("idx", "rank", "before_req").collect()
    assert len(a) == len(rows)
    b = window_rank(df, ["q"], order, ["req"]).select("idx", "rank", "before_req").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_number_of_ranges_follows_rows_and_bytes(spark, monkeypatch):
    """A queue above one range equals the window, other columns included; only the narrow part is sorted into ranges."""
    df = spark.createDataFrame([("big" if i % 3 else None, i % 11, i, i % 5, "payload" * 20) for i in range(900)],
                               "q string, score int, idx long, req int, note string")
    order = ["score desc", "idx"]
    df = materialize(df, "rows")
    assert R.ranges_for(df, 900) == 1
    monkeypatch.setattr(R, "RANGE_ROWS", 100)
    assert R.ranges_for(df, 900) == 9
    written = []
    monkeypatch.setattr(R, "materialize", lambda d, name: written.append((name, d.columns)) or materialize(d, name))
    got = rank_rows(df, ["q"], order, ["req"]).collect()
    want = window_rank(df, ["q"], order, ["req"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 900
    assert dict(written)["ranges"] == ["q", "score", "idx", "req", "_row", "_rp"]


def test_extract_vms(spark):
    text = "Traffic Advisory\n\nVMS SIGNBOARD MESSAGE:\n[ DIVERSION: MG ROAD CLOSED ]\n\nmore"
    df = spark.createDataFrame([(text,), ("no message here",)], "t string")
    got = [r[0] for r in df.select(DP.extract_vms(F.col("t"))).collect()]
    assert got == ["DIVERSION: MG ROAD CLOSED", "See advisory text"]


def test_rank_rows_without_keys(spark):
    df = spark.createDataFrame([(i % 13, i, i % 5) for i in range(400)], "score int, idx long, req int")
    order = [F.col("score").desc(), F.col("idx").asc()]
    g = rank_rows(df, [], order, ["req"], n_ranges=7).select("idx", "rank", "before_req").collect()
    w = window_rank(df, [], order, ["req"]).select("idx", "rank", "before_req").collect()
    assert sorted(map(tuple, g)) == sorted(map(tuple, w))
