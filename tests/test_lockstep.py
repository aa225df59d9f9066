"""Growers on coded rows, and the linear members of votes (EX8, EX9, EX11, EX12)."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from roadcast.operators import boosting as B
from roadcast.operators import linear
from roadcast.operators import lockstep as L
from roadcast.operators import ml as ML
from test_ml import table


def test_a_level_is_one_job_without_library_fits(spark, monkeypatch):
    jobs, level = [], L._level
    monkeypatch.setattr(L, "_level", lambda held, shared, tree, at, group: jobs.append((tree, at, len(group))) or level(held, shared, tree, at, group))
    t = table(spark, 150, 2)
    apart = B.forests(t.rows, t.widths, [0, None], 9, 4, 2, True)
    lockstep = B.forests(t.rows, t.widths, [0, None], 9, 4, 2, True, small_bytes=0)
    assert 1 <= len(jobs) <= 4 and jobs[0] == (0, 0, 18)
    np.testing.assert_array_equal(apart.feature, lockstep.feature)
    np.testing.assert_array_equal(apart.value, lockstep.value)


@pytest.mark.parametrize("widths,n", [([3, 24, 24, 2, 2], 3000), ([32] * 6, 500), ([2], 1)])
def test_codes_give_the_histogram_of_their_features(widths, n):
    rng = np.random.default_rng(n)
    bins = np.column_stack([rng.integers(0, w, n) for w in widths]).astype(np.uint8)
    if len(widths) == 5:
        bins[:, 2] = 23 - bins[:, 1]  # one follows from the other
        bins[:, 3] *= rng.random(n) < 0.02  # rare
    rows = L.Rows(np.arange(n), rng.random(n), np.zeros(n, dtype=np.int16), None, bins)
    work = L.Sums(L.coded(rows, widths), widths)
    assert len(work.codes) <= len(widths) and (len(widths) != 5 or len(work.codes) < 4)
    member = L._Member(L._Part(work, np.arange(n)))
    residual = rng.integers(-4 << 20, 4 << 20, n).astype(float)
    member.start(None, residual)
    member.at = rng.integers(1, 4, n)  # node 1 is closed
    got = member.histogram(1, sum(widths))
    starts = np.r_[0, np.cumsum(widths)[:-1]]
    for node in (2, 3):
        for f, w in enumerate(widths):
            for b in range(w):
                own = (member.at == node) & (bins[:, f] == b)
                assert tuple(got[node - 2, starts[f] + b]) == (own.sum(), residual[own].sum())


def test_bags_hold_a_row_once_on_average():
    ids = np.arange(200_000) * 7919
    bags = np.stack([L.bag(ids, t, 42) for t in range(6)])
    assert abs(bags.mean() - 1) < 0.01 and abs((bags == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(bags)[~np.eye(6, dtype=bool)]).max() < 0.01


def test_linear_members_equal_the_library(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression
    made = table(spark, 150, 3)
    t, inputs = made.rows.withColumn("y", ((F.hash("id") % 3 == 0) | (F.col("y") == 1)).cast("double")), len(made.widths)
    sums = linear.products(t, inputs, [0, 1, 2])
    logit, lines = linear.logistic(t, inputs, sums, [1, None], 0.01), {h: linear.ridge(s, 0.1) for h, s in sums.items()}
    for h, train in ((1, t.where("fold <> 1")), (None, t)):
        for own, e in ((logit[h], LogisticRegression(maxIter=200, tol=1e-12, regParam=0.01, labelCol="y")), (lines[h], LinearRegression(regParam=0.1, labelCol="y"))):
            model = e.fit(train)
            x = np.array([r[0] for r in t.select(vector_to_array("features")).collect()])
            np.testing.assert_allclose(x @ own[:-1] + own[-1], x @ model.coefficients.toArray() + model.intercept, atol=1e-4)


def test_votes_make_no_library_fit(spark, monkeypatch):
    import pyspark.ml.classification as C
    monkeypatch.setattr(C.RandomForestClassifier, "fit", None)
    monkeypatch.setattr(C.LogisticRegression, "fit", None)
    got = ML.out_of_fold_scores(table(spark, 60, 2), folds=2).collect()
    assert len(got) == 60 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.score for r in got if r.y]) > np.mean([r.score for r in got if not r.y]) + 0.3


def test_flags_need_no_quantiles(spark):
    from roadcast.operators.features import numeric_cuts
    rows = spark.createDataFrame([(k % 2, k % 5, float(k % 2), None) for k in range(100)], "flag int, five int, real double, none int")
    assert numeric_cuts(rows, 1, ["flag", "five", "real", "none"]) == [[0.5], [0.0], [0.0, 1.0, 2.0, 3.0], [0.0], [0.0]]


def test_a_grid_grows_apart_and_is_scored_once(spark, monkeypatch):
    scored, held_out_f1 = [], ML.held_out_f1
    monkeypatch.setattr(ML, "held_out_f1", lambda rows, grown, marks: scored.append((len(grown.models), list(marks))) or held_out_f1(rows, grown, marks))
    monkeypatch.setattr(B, "TINY_BYTES", 0)
    monkeypatch.setattr(L, "_level", None)
    axes = {k: v[:1] for k, v in ML.TUNING_AXES.items()} | {"maxIter": [2, 4], "maxDepth": [2]}
    got = {r.max_iter: r.f1 for r in ML.cv_tuning(table(spark, 90, 3), folds=3, axes=axes).collect()}
    assert scored == [(3, [2, 4])] and set(got) == {2, 4} and got[4] > 0.9


def test_a_block_is_kept_as_chunks(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_ROWS", 7)
    t = B._counted(table(spark, 90, 3).rows)
    widths = table(spark, 90, 3).widths

    def small(batches):  # read in the workers too
        L.CHUNK_ROWS = 7
        yield from batches
    held = L.blocks(t.select("row_hash", "y", "fold", "n", "bins").mapInArrow(small, "row_hash long, y double, fold int, n double, bins binary"), widths, True, 2)
    held = held.toArrow().to_batches()
    assert sum(len(b) for b in held) >= 12 and max(len(x.as_py()) for b in held for x in b.column(1)) <= 7 * 8
    found = list(L._opened(iter(held)))
    assert sum(len(rows.y) for rows, _ in found) == 90 and len(found) <= 2
    ids = np.concatenate([rows.ids for rows, _ in found])
    assert sorted(ids.tolist()) == sorted(r.row_hash for r in t.collect())
    divided = [b.slice(k, 1) for b in held for k in range(len(b))][5:]  # a read may begin inside a block
    assert sum(len(rows.y) for rows, _ in L._opened(iter(divided))) < 90
