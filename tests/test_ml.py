"""Tuning, stacking, out-of-fold scores and encodings (EX5, EX8, EX10-EX12)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadcast.operators import boosting as B
from roadcast.operators import experiment as EX
from roadcast.operators import features as FT
from roadcast.operators import ml as ML
from roadcast.operators import validate as VA
from roadcast.plans import QUERIES


def rows(spark, n=150):
    return spark.createDataFrame([(f"i{i}", "abc"[i % 3], i % 2, float(i % 7), int(i % 3 == 0)) for i in range(n)],
                                 "id string, cause string, weekend_int int, size double, y int")


def table(spark, n=150, folds=5):
    return FT.feature_table(FT.folded(rows(spark, n), None, folds, 42), ["cause"], ["weekend_int", "size"], F.col("y"))


def test_tuning_runs_five_folds_over_five_axes(spark):
    assert len(ML.TUNING_AXES) == 5 and all(len(v) > 1 for v in ML.TUNING_AXES.values())
    axes = {k: v[:1] for k, v in ML.TUNING_AXES.items()} | {"maxIter": [2, 3], "maxDepth": [1, 2]}
    got = ML.cv_tuning(table(spark, 150, 2), folds=2, axes=axes).collect()
    assert [(r.max_iter, r.max_depth, r.feature_subset) for r in got] == [(2, 1, "0.8"), (2, 2, "0.8"), (3, 1, "0.8"), (3, 2, "0.8")]
    assert max(r.f1 for r in got) > 0.9  # the label is the cause


def test_out_of_fold_scores_hold_every_row_once(spark):
    assert "oof_threshold" in QUERIES
    scored = ML.out_of_fold_scores(table(spark, 60, 2), folds=2).cache()
    assert sorted(r.id for r in scored.collect()) == sorted(f"i{i}" for i in range(60))
    sweep = [r.threshold for r in VA.threshold_sweep(scored, 0.05, 0.95).orderBy("threshold_index").collect()]
    assert len(sweep) == 90 and abs(sweep[0] - 0.05) < 1e-9 and abs(sweep[-1] - 0.94) < 1e-9


@pytest.mark.parametrize("loss", ["log", "squared"])
def test_lockstep_grows_the_trees_that_single_tasks_grow(spark, loss):
    t = table(spark, 150, 3)
    models = [B.Model(B.Setting(0.1, depth, share, features), fold) for depth, share, features in ((1, 1.0, 1.0), (3, 0.7, 0.6)) for fold in (0, None)]
    apart, one = B.boosted(t.rows, t.widths, models, 7, loss, marks=(3,))
    lockstep, many = B.boosted(t.rows.repartition(5), t.widths, models, 7, loss, marks=(3,), small_bytes=0)
    for name in ("feature", "cut", "value"):
        np.testing.assert_array_equal(getattr(apart, name), getattr(lockstep, name))
    assert (apart.feature >= 0).any()
    read = lambda s: {r.id: bytes(r.margins) for r in s.collect()}
    for mark in (3, 7):
        a, b = read(one[mark]), read(many[mark])
        assert all(np.allclose(np.frombuffer(a[k]), np.frombuffer(b[k])) for k in a) and a.keys() == b.keys()


def test_first_tree_is_the_least_squares_split(spark):
    t = table(spark)
    grown, _ = B.boosted(t.rows, t.widths, [B.Model(B.Setting(0.1, 1), None)], 1, "squared")
    assert grown.feature[0, 0, 1] == 0  # cause a
    assert abs(grown.value[0, 0, 2]) < 1e-9 and abs(grown.value[0, 0, 3] - 1) < 1e-9


def test_stack_predicts_rows_that_are_not_trained_on(spark):
    frame = rows(spark, 120).withColumns({"event_type": F.lit("planned"), "duration_minutes": F.when(F.col("cause") == "a", 100.0).otherwise(10.0)})
    folded = FT.folded(frame.where("id < 'i7'"), frame.where("id >= 'i7'"), 5, 42)
    t = FT.feature_table(folded, ["cause"], ["weekend_int"], F.log1p("duration_minutes"), ["event_type", "duration_minutes"])
    got = ML.stacked_regression([t]).collect()
    assert len(got) == frame.where("id >= 'i7'").count()
    error = np.mean([abs(r.predicted_minutes - r.duration_minutes) for r in got])
    assert error < 45  # the mean's error is 40 % of 90 minutes and more


def test_encodings_leave_the_own_fold_out(spark):
    data = [(0, "a", 1), (0, "a", 0), (1, "a", 1), (1, None, 1), (2, "b", 0), (2, "a", 1)]
    got = {(r.category, r.fold): (r.n, r.encoding) for r in EX.encodings(
        spark.createDataFrame(data, "fold int, c string, y int"), ["c"], "y", 3, 2.0).collect()}
    for cat in ("a", None, "b"):
        for fold in (0, 1, 2, -1):
            rest = [(c, y) for f, c, y in data if f != fold]
            own = [y for c, y in rest if c == cat]
            prior = sum(y for _, y in rest) / len(rest)
            n, e = got[cat, fold]
            assert n == len(own) and abs(e - (sum(own) + 2 * prior) / (len(own) + 2)) < 1e-12


def test_folds_are_sql_hashes(spark):
    import hashlib
    got = {r.id: r.f for r in rows(spark, 30).select("id", FT.fold_of("id", 5, 42).alias("f")).collect()}
    assert got == {k: int(hashlib.md5(f"{k}:42".encode()).hexdigest()[:8], 16) % 5 for k in got}


def test_counted_rows_grow_the_trees_of_all_rows(spark):
    t = table(spark, 150, 3)
    models = [B.Model(B.Setting(0.1, 2), f) for f in (0, None)]
    counted = t.rows.groupBy("fold", "bins", "y").agg(F.count(F.lit(1)).alias("n"), F.min("row_hash").alias("row_hash"))
    assert counted.count() < 150
    for small in (B.SMALL_BYTES, 0):
        one, two = (B.boosted(x, t.widths, models, 6, "squared", small_bytes=small)[0] for x in (t.rows, counted))
        np.testing.assert_array_equal(one.feature, two.feature)
        np.testing.assert_array_equal(one.value, two.value)


def test_durations_are_learned_from_counted_inputs(spark):
    t = spark.createDataFrame([(i, ["planned", "unplanned"][i % 2], ["a", "b", None][i % 3], i % 4 // 2, float(10 + 90 * (i % 3 == 0))) for i in range(240)],
                              "id int, event_type string, cause string, flag int, duration_minutes double")
    got = ML.duration_regression(t.where("id < 180"), t.where("id >= 180"), ["cause"], ["flag"]).collect()
    assert sorted(r.id for r in got) == list(range(180, 240))
    assert all(abs(r.predicted_minutes - r.duration_minutes) < 1 for r in got)
