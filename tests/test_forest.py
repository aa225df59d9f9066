"""Forests on counted rows (VA8, VA9, VA17, EX14)."""

import numpy as np
from pyspark.sql import functions as F

from roadcast.operators import forest
from roadcast.operators import ml as ML


def rows(spark, n=400):
    return spark.createDataFrame([(f"i{i}", "abc"[i % 3] if i % 7 else None, i % 2, "yes" if i % 3 == 0 else "no") for i in range(n)],
                                 "id string, cause string, flag int, y string")


def test_forest_grows_on_distinct_rows_and_learns_the_label(spark, monkeypatch):
    asked = []
    grown = forest.grown
    monkeypatch.setattr(forest, "grown", lambda counted, *a: asked.append(counted.collect()) or grown(counted, *a))
    t = rows(spark)
    model, scored = ML.random_forest(t, t, ["cause"], ["flag"], "y", 20, 4, False)
    assert sum(r.n for r in asked[0]) == 400 and len(asked[0]) == len({(bytes(r.bins), r.label) for r in asked[0]}) <= 12
    got = scored.where("cause is not null").collect()
    assert len(got) == t.where("cause is not null").count() and scored.count() == 400
    assert all(r.predicted == r.y and abs(sum(r.probability) - 1) < 1e-9 for r in got)
    importance = {r.feature: r.importance for r in ML.feature_importances(model, t, ["cause"], ["flag"]).collect()}
    assert max(importance, key=importance.get) == "cause_a" and abs(sum(importance.values()) - 1) < 1e-3


def test_forest_does_not_depend_on_partitions(spark):
    t = rows(spark)
    a, b = (forest.fit(x, ["cause"], ["flag"], "y", 5, 3, 42, True).trees for x in (t, t.repartition(7)))
    np.testing.assert_array_equal(a.feature, b.feature)
    np.testing.assert_array_equal(a.counts, b.counts)
    assert (a.counts[:, 1].sum(axis=1) > 300).all()  # a bag has about as many rows as the table


def test_saved_forest_scores_as_before(spark, tmp_path):
    t = rows(spark).withColumn("size", F.col("flag") * 2.5)
    model = forest.fit(t, ["cause"], ["flag", "size"], "y", 5, 3, 42)
    model.save(str(tmp_path / "m"))
    read = lambda m: {r.id: (list(r.probability), r.predicted) for r in m.transform(t).collect()}
    assert read(forest.ForestModel.load(spark, str(tmp_path / "m"))) == read(model)
