"""Model features and MLlib models (VA7-VA9, VA17, EX1-EX14).

Feature columns are built-in expressions; encoders and models are MLlib
estimators fitted on the train fold only and applied to every fold, so the
train layout (vocabulary, one-hot width) carries over and unseen categories
encode as all zeros. Forests will not equal scikit-learn's bit for bit.
"""

from __future__ import annotations

import functools

import math

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadcast.functions import expressions as X
from roadcast.operators import forest, linear
from roadcast.operators.boosting import Model, Setting, boosted, forests, held_out_f1, predicted
from roadcast.operators.features import NOT_TRAINED, FeatureTable, feature_table
from roadcast.operators.sizing import materialize

# FIXED VALUES: severity keywords searched in description + comment (case-insensitive substring).
SEVERITY_TERMS = [
    "fatal", "waterlog", "water log", "flooded", "pileup", "closure",
    "breakdown", "vip", "protest", "rally", "tree fall", "fallen tree",
    "bwssb", "bescom", "bbmp", "bda", "white topping", "asphalting",
    "accident", "lorry", "bus", "crane", "tow", "pothole",
]
RANDOM_STATE = 42


def keyword_column(term: str) -> str:
    return "kw_" + term.replace("-", "_").replace(" ", "_")


def model_frame(clean: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """CL11: fills for model use; description from documents (doc_id = id), comment ''."""
    df = clean
    if documents is not None:
        docs = documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("description"))
        df = df.join(docs, df["id"] == docs["_doc"], "left").drop("_doc")
    else:
        df = df.withColumn("description", F.lit(None).cast("string"))
    return df.withColumns({
        "priority": F.coalesce("priority", F.lit("Unknown")),
        "corridor": F.coalesce("corridor", F.lit("Non-corridor")),
        "event_cause": F.coalesce("event_cause", F.lit("unknown")),
        "event_type": F.coalesce("event_type", F.lit("unplanned")),
        "description": F.coalesce("description", F.lit("")),
        "comment": F.lit(""),
        "latitude": F.coalesce(F.col("latitude").cast("double"), F.lit(0.0)),
        "longitude": F.coalesce(F.col("longitude").cast("double"), F.lit(0.0)),
        "closure_int": F.coalesce(F.col("requires_road_closure"), F.lit(False)).cast("int"),
        "weekend_int": F.coalesce(F.col("is_weekend"), F.lit(False)).cast("int"),
    })


def cyclic_features(df: DataFrame) -> DataFrame:
    """EX1: sin/cos of hour (period 24) and weekday (period 7)."""
    two_pi = F.lit(2.0) * F.lit(math.pi)
    h, d = F.col("hour_of_day").cast("double"), F.col("day_of_week").cast("double")
    return df.withColumns({
        "hour_sin": F.sin(two_pi * h / F.lit(24.0)), "hour_cos": F.cos(two_pi * h / F.lit(24.0)),
        "dow_sin": F.sin(two_pi * d / F.lit(7.0)), "dow_cos": F.cos(two_pi * d / F.lit(7.0)),
    })


def keyword_flags(df: DataFrame) -> DataFrame:
    """EX2: 24 keyword flags over the whole description + comment text, one projection."""
    text = F.lower(F.concat_ws(" ", F.col("description"), F.col("comment")))
    return df.withColumns({keyword_column(t): text.contains(t).cast("int") for t in SEVERITY_TERMS})


def crossed_features(df: DataFrame) -> DataFrame:
    """EX3: corridor x cause, corridor x priority, cause x priority."""
    return df.withColumns({
        "corridor_cause": F.concat_ws("_", "corridor", "event_cause"),
        "corridor_priority": F.concat_ws("_", "corridor", "priority"),
        "cause_priority": F.concat_ws("_", "event_cause", "priority"),
    })


def severe_label(df: DataFrame) -> DataFrame:
    """EX6: closure, or a duration of at least 60 minutes (null duration -> not severe)."""
    return df.withColumn("severe_impact", (F.coalesce(F.col("requires_road_closure"), F.lit(False))
                                           | F.coalesce(F.col("duration_minutes") >= 60, F.lit(False))).cast("int"))


def target_encoding(train: DataFrame, col: str, label: str, smoothing: float = 10.0) -> DataFrame:
    """EX5: (sum(y) + m * prior) / (n + m) per category, fitted on train."""
    stats = train.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("_s"))
    prior = train.agg(F.avg(label).alias("_prior"))
    from roadcast.operators.validate import attach_scalar
    j = attach_scalar(stats, prior)
    return j.select(col, "n", X.np_round((F.col("_s") + F.lit(smoothing) * F.col("_prior"))
                                         / (F.col("n") + F.lit(smoothing)), 6).alias("encoding"))


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c), one row per class (broadcast)."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = c.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    from roadcast.operators.validate import attach_scalar
    return attach_scalar(c, tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("weight"))


def random_forest(train: DataFrame, test: DataFrame, categorical: list[str], numeric: list[str], label: str,
                  trees: int, depth: int, balanced: bool):
    """VA8/VA9: forest with optional balanced class weights; returns (model, scored test)."""
    model = forest.fit(train, categorical, numeric, label, trees, depth, RANDOM_STATE, balanced)
    return model, model.transform(test).withColumn("p_positive", F.element_at("probability", -1))


def feature_importances(model, train: DataFrame, categorical: list[str], numeric: list[str]):
    """VA17: named importances > 0.0001, descending (names from the fitted layout)."""
    rows = [(n, float(v)) for n, v in zip(model.names, model.trees.importances()) if v > 0.0001]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def geo_clusters(train: DataFrame, df: DataFrame, k: int = 50) -> DataFrame:
    """EX4: k-means on train coordinates, applied to all rows."""
    asm = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="coords")
    km = KMeans(k=k, seed=RANDOM_STATE, featuresCol="coords", predictionCol="geo_cluster")
    model = Pipeline(stages=[asm, km]).fit(train)
    return model.transform(df).drop("coords")


def duration_regression(train: DataFrame, test: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """EX7: boosted trees on log1p(duration), one model per event type, expm1 back."""
    return functools.reduce(DataFrame.unionByName, [
        _timed(train.where((F.col("event_type") == etype) & F.col("duration_minutes").isNotNull()),
               test.where(F.col("event_type") == etype), categorical, numeric) for etype in ("planned", "unplanned")])


def _timed(train: DataFrame, test: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Squared-error trees need rows and the sum of labels of equal inputs only: they grow on these, and score each input once."""
    inputs = [*categorical, *numeric]
    unit = F.lit(float(1 << 20))  # whole sums, in any order
    known = train.groupBy(*inputs).agg(F.count(F.lit(1)).alias("n"), F.sum(F.rint(F.log1p("duration_minutes") * unit).cast("long")).alias("_s"))
    known = known.select(*inputs, "n", (F.col("_s") / unit / F.col("n")).alias("y"), F.lit(0).alias("fold"))
    asked = test.select(*inputs).distinct().select(*inputs, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("y"), F.lit(NOT_TRAINED).alias("fold"))
    each = known.unionByName(asked).withColumn("id", F.to_json(F.struct("fold", *inputs)))
    table = feature_table(each, categorical, numeric, F.col("y"), [*inputs, "n"])
    models = [Model(Setting(), None)]
    grown, _ = boosted(table.rows, table.widths, models, 50, "squared")
    scored = table.rows.where(F.col("fold") == NOT_TRAINED).withColumn("margin", predicted(table.rows.sparkSession, grown))
    side = materialize(scored.select(*(F.col(c).alias(f"_in{k}") for k, c in enumerate(inputs)), F.expm1("margin").alias("predicted_minutes")), "timed")
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_in{k}")) for k, c in enumerate(inputs)])
    return test.join(side, same, "left").select("id", "event_type", "duration_minutes", "predicted_minutes")


def regression_metrics(pred: DataFrame, y: str = "duration_minutes", p: str = "predicted_minutes") -> DataFrame:
    """EX13: R-squared and MAE in one aggregate pass."""
    d = pred.where(F.col(y).isNotNull())
    m = d.agg(F.avg(y).alias("_mean"))
    from roadcast.operators.validate import attach_scalar
    j = attach_scalar(d, m)
    a = j.agg(F.sum((F.col(y) - F.col(p)) ** 2).alias("_sse"), F.sum((F.col(y) - F.col("_mean")) ** 2).alias("_sst"),
              F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"), F.count(F.lit(1)).alias("rows"))
    return a.select("rows", F.when(F.col("_sst") == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.col("_sse") / F.col("_sst"))
                    .alias("r2"), "mae")


def _in_parallel(jobs: list, at_once: int = 4) -> list:
    """Results of fits that Spark may run side by side."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def _voted(table: FeatureTable, held_out: list, rows: DataFrame) -> DataFrame:
    """``rows`` with score: the mean of three members' probabilities, by models that hold out the row's fold (None: all rows trained).

    Boosted trees, a forest of 100 trees of depth 8 and a logistic regression, each grown for all of ``held_out`` at once.
    """
    spark, inputs = table.rows.sparkSession, len(table.widths)
    forest_ = forests(table.rows, table.widths, held_out, 100, 8, math.ceil(math.sqrt(inputs)), True, RANDOM_STATE)
    boosted_, _ = boosted(table.rows, table.widths, [Model(Setting(), fold) for fold in held_out], 50, "log")
    trained = table.rows.where(F.col("fold") >= 0)
    folds = sorted({f for f in held_out if f is not None} or {r["fold"] for r in trained.select("fold").distinct().collect()})
    logit = linear.logistic(trained, inputs, linear.products(trained, inputs, folds), held_out, 0.01)
    likely = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    members = [likely(F.lit(2.0) * predicted(spark, boosted_)), predicted(spark, forest_), likely(linear.predicted(spark, logit))]
    return rows.withColumn("score", functools.reduce(Column.__add__, members) / F.lit(3.0))


def soft_vote(table: FeatureTable, kept: tuple = ()) -> DataFrame:
    """EX9: (id, kept, y, score) of the rows that aren't trained on; score is the members' mean probability; no join."""
    scored = _voted(table, [None], table.rows.where(F.col("fold") == NOT_TRAINED))
    return scored.select("id", *kept, F.col("y").cast("int").alias("y"), "score")


#: EX11's axes: trees, rate, depth, row and column sampling.
TUNING_AXES = {"maxIter": [20, 50], "stepSize": [0.05, 0.1], "maxDepth": [3, 5], "subsamplingRate": [0.8, 1.0],
               "featureSubsetStrategy": ["0.8", "all"]}


def cv_tuning(table: FeatureTable, folds: int = 5, axes: dict[str, list] = TUNING_AXES) -> DataFrame:
    """EX11: k-fold cross-validated grid of boosted trees over ``axes`` (mean F1 of the positive class over the folds).

    All points and folds grow in lockstep on one encoded table, each depth in a chain of its own; points that differ in
    the number of trees share a model.
    """
    import itertools
    share = {c: 1.0 if c == "all" else float(c) for c in axes["featureSubsetStrategy"]}

    def grown(depth: int) -> dict[tuple, float]:
        settings = list(itertools.product(axes["stepSize"], [depth], axes["subsamplingRate"], axes["featureSubsetStrategy"]))
        models = [Model(Setting(s, d, r, share[c]), fold) for s, d, r, c in settings for fold in range(folds)]
        trees_, _ = boosted(table.rows, table.widths, models, max(axes["maxIter"]), "log")
        found = held_out_f1(table.rows, trees_, axes["maxIter"]).collect()
        out = {}
        for trees in axes["maxIter"]:
            f1 = {r["model"]: r["f1"] for r in found if r["trees"] == trees}
            out |= {(trees, *p): sum(f1[k * folds + fold] for fold in range(folds)) / folds for k, p in enumerate(settings)}
        return out

    found = {}
    for part in _in_parallel([lambda d=d: grown(d) for d in axes["maxDepth"]]):
        found |= part
    points = itertools.product(*(axes[name] for name in TUNING_AXES))
    return table.rows.sparkSession.createDataFrame(
        [(*p, float(found[p])) for p in points],
        "max_iter int, step_size double, max_depth int, subsampling_rate double, feature_subset string, f1 double")


def out_of_fold_scores(table: FeatureTable, folds: int = 5) -> DataFrame:
    """EX12: every training row's soft-vote score by models fitted on the other folds."""
    return _voted(table, list(range(folds)), table.rows.where(F.col("fold") >= 0)).select("id", F.col("y").cast("int").alias("y"), "score")


def stacked_regression(tables: list[FeatureTable], folds: int = 5) -> DataFrame:
    """EX8: out-of-fold predictions of boosted trees, forest and linear models, ridge on top; a table for each event type."""
    return functools.reduce(DataFrame.unionByName, _in_parallel([lambda t=t: _stacked(t, folds) for t in tables]))


def _stacked(table: FeatureTable, folds: int) -> DataFrame:
    from pyspark.ml.regression import LinearRegression
    spark, inputs, held_out = table.rows.sparkSession, len(table.widths), [*range(folds), None]
    forest_ = forests(table.rows, table.widths, held_out, 50, 8, math.ceil(inputs / 3), False, RANDOM_STATE)
    boosted_, _ = boosted(table.rows, table.widths, [Model(Setting(), fold) for fold in held_out], 30, "squared")
    sums = linear.products(table.rows.where(F.col("fold") >= 0), inputs, list(range(folds)))
    lines = {h: linear.ridge(s, 0.1) for h, s in sums.items()}
    scored = table.rows.withColumns({"p_gbt": predicted(spark, boosted_), "p_rf": predicted(spark, forest_), "p_lin": linear.predicted(spark, lines)})
    meta_rows = materialize(scored.drop("features", "bins"), "stack")
    meta_cols = ["p_gbt", "p_rf", "p_lin"]
    ridge = LinearRegression(featuresCol="meta", labelCol="y", regParam=1.0, elasticNetParam=0.0)
    meta = Pipeline(stages=[VectorAssembler(inputCols=meta_cols, outputCol="meta"), ridge]).fit(meta_rows.where(F.col("fold") >= 0))
    out = meta.transform(meta_rows.where(F.col("fold") == NOT_TRAINED))
    return out.select("id", F.expm1("prediction").alias("predicted_minutes"), "event_type", "duration_minutes")


def export_model(train: DataFrame, categorical: list[str], numeric: list[str], path: str, label: str = "y"):
    """EX14/SC9: fit on all rows, save the whole model (vocabularies and layout included), reload."""
    forest.fit(train, categorical, numeric, label, 100, 8, RANDOM_STATE).save(path)
    return forest.ForestModel.load(train.sparkSession, path)
