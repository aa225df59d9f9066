"""Chronological benchmarks and metrics (VA1-VA6, VA10-VA16, VA18).

* splits compare rows with the exact (time, id) boundaries of
  :mod:`roadcast.operators.cuts`; no row is ranked or exchanged for them;
* labels and rule predictions reuse the tier-chain join against a
  train-only baseline - no per-row loop;
* the threshold sweep aggregates scores into one bucket per threshold
  interval first, so its work is (thresholds + distinct scores), with no
  join of every threshold to every score;
* average precision is a running sum over distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.functions import expressions as X
from roadcast.operators import baseline as BL
from roadcast.operators import cuts
from roadcast.operators import forecast as FC
from roadcast.operators.match import baselines_from_grains, tiered_match
from roadcast.operators.ranking import rank_rows
from roadcast.operators.sizing import materialize

CLASSES = ["Low", "Medium", "High"]


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate (broadcast equi-join on a constant key)."""
    one = one_row.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


# --- splits -------------------------------------------------------------------

def chrono_split(df: DataFrame, folds: list[tuple[str, float]], last: str,
                 time_col: str = "start_datetime") -> DataFrame:
    """``fold`` by order of (time, id): the first floor(n * share) rows belong to each named fold; no row is ranked."""
    hour = F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / F.lit(3_600_000_000))
    return cuts.with_fold(df, time_col, "id", hour, folds, last)


def split_positions(df: DataFrame, time_col: str = "start_datetime") -> DataFrame:
    """(id, split_pos): the rank by (time, id) that the cuts stand for."""
    return rank_rows(df.select("id", time_col), [], [time_col, "id"], rank_col="split_pos").select("id", "split_pos")


def split_80_20(clean: DataFrame) -> DataFrame:
    """VA1: has-duration rows, oldest 80 % train."""
    return chrono_split(clean.where(F.col("has_duration")), [("train", 0.8)], "test")


def split_70_15_15(clean: DataFrame) -> DataFrame:
    """VA2: rows with a start; 70 / 15 / 15; label y = closure as 0/1."""
    s = chrono_split(clean.where(F.col("start_datetime").isNotNull()),
                     [("train", 0.70), ("validation", 0.85)], "test")
    return s.withColumn("y", F.coalesce(F.col("requires_road_closure"), F.lit(False)).cast("int"))


# --- labels and rule predictions (3-class) ------------------------------------------

def _as_incoming(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("incident_id"), "event_cause", F.col("corridor").alias("match_corridor"),
                       "is_weekend", "hour_bucket", "requires_road_closure", "duration_minutes", "priority",
                       "fold")


def labelled(split: DataFrame) -> DataFrame:
    """VA3/VA4/VA5: train-only baseline, true severity and rule prediction per row."""
    train = split.where(F.col("fold") == "train")
    base = baselines_from_grains(BL.all_grains(train))
    m = tiered_match(_as_incoming(split), base)
    flag = F.col("requires_road_closure")
    reliable = (F.col("duration_count") >= C.RELIABLE_SAMPLE_THRESHOLD) & F.col("duration_minutes").isNotNull()
    closure = F.when(F.coalesce(flag, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
    true_base = F.when(reliable, X.severity_by_duration(F.col("duration_minutes"))) \
        .otherwise(X.severity_by_score(X.closure_priority_score(closure, F.col("priority"))))
    m = m.withColumn("true_severity", X.apply_bump(true_base, flag))
    pred = FC.severity_columns(m)
    return pred.select("incident_id", "fold", "event_cause", "match_level", "duration_count",
                       "true_severity", F.col("severity_tier").alias("rule_prediction"))


def corridor_vocab(train: DataFrame, k: int = C.TOP_K_CORRIDORS_MODEL) -> DataFrame:
    """VA6: the k most frequent train corridors (ties by name)."""
    return (train.groupBy("corridor").agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), F.asc("corridor")).limit(k))


def with_corridor_clean(df: DataFrame, vocab: DataFrame) -> DataFrame:
    v = F.broadcast(vocab.select(F.col("corridor").alias("_v")))  # at most k rows
    j = df.join(v, df["corridor"] == v["_v"], "left")
    return j.withColumn("corridor_clean", F.when(F.col("_v").isNotNull(), F.col("corridor"))
                        .otherwise(F.lit("Other"))).drop("_v")


# --- metrics ---------------------------------------------------------------------------

def confusion(pairs: DataFrame, truth: str, pred: str, labels=CLASSES + ["Unknown"]) -> DataFrame:
    """VA15: counts of (truth, prediction), predictions pivoted to columns."""
    return pairs.groupBy(F.col(truth).alias("true_label")).pivot(pred, labels).count().na.fill(0)


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def class_report(pairs: DataFrame, truth: str, pred: str) -> DataFrame:
    """VA16: per-class precision/recall/F1/support, macro and weighted averages."""
    cm = pairs.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    cls = cm.select(F.col("t").alias("label")).union(cm.select(F.col("p").alias("label"))).distinct()
    sup = cm.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    tp = cm.where(F.col("t") == F.col("p")).select(F.col("t").alias("label"), F.col("n").alias("tp"))
    per = (cls.join(sup, "label", "left").join(prd, "label", "left").join(tp, "label", "left")
           .na.fill(0, ["support", "predicted", "tp"]))
    per = per.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")),
                           "recall": _ratio(F.col("tp"), F.col("support"))})
    per = per.withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    tot = per.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum("support").alias("s"),
                  _ratio(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                  _ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                  _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"),
                  _ratio(F.sum("tp"), F.sum("support")).alias("acc"))
    rows = per.select("label", "precision", "recall", "f1", "support").unionByName(
        tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                   F.col("mf").alias("f1"), F.col("s").alias("support"))).unionByName(
        tot.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                   F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("s").alias("support"))).unionByName(
        tot.select(F.lit("accuracy").alias("label"), F.col("acc").alias("precision"), F.col("acc").alias("recall"),
                   F.col("acc").alias("f1"), F.col("s").alias("support")))
    return rows.select("label", *[X.np_round(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")],
                       "support")


def majority_label(train: DataFrame, label: str) -> DataFrame:
    """VA10: the most frequent train label (smallest on ties)."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return c.agg(F.min_by(label, F.struct((-F.col("_n")).alias("n"), F.col(label).alias("l"))).alias("majority"))


def cause_rate_scores(split: DataFrame) -> DataFrame:
    """VA11: train closure rate per cause; unseen causes get the global train rate."""
    train = split.where(F.col("fold") == "train")
    rates = train.groupBy("event_cause").agg(F.avg("y").alias("_rate"))
    glob = train.agg(F.avg("y").alias("_global"))
    other = split.where(F.col("fold") != "train")
    j = attach_scalar(other.join(materialize(rates, "rates"), "event_cause", "left"), glob)
    return j.select("id", "fold", "y", "event_cause", F.coalesce("_rate", "_global").alias("score"))


def threshold_value(i: Column, start: float = 0.02, step: float = 0.01) -> Column:
    """i-th threshold exactly as ``numpy.arange(start, stop, step)`` builds it."""
    delta = (start + step) - start
    return F.lit(start) + i.cast("double") * F.lit(delta)


def threshold_sweep(scored: DataFrame, start: float = 0.02, stop: float = 0.99, step: float = 0.01) -> DataFrame:
    """VA12: F1 at every threshold; ``is_best`` marks the first best (lowest threshold)."""
    import math
    spark = scored.sparkSession
    n_t = int(math.ceil((stop - start) / step))
    delta = (start + step) - start
    s = scored.select("score", "y")
    # b = number of thresholds <= score, exact against the threshold doubles.
    k = F.floor((F.col("score") - F.lit(start)) / F.lit(delta)).cast("long")
    t_at = lambda j: F.lit(start) + j.cast("double") * F.lit(delta)
    b = (F.when(t_at(k + 1) <= F.col("score"), k + 2).when(t_at(k) <= F.col("score"), k + 1).otherwise(k))
    b = F.least(F.greatest(b, F.lit(0)), F.lit(n_t))
    hist = s.groupBy(b.alias("b")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    totals = s.agg(F.sum("y").alias("P"))
    th = spark.range(n_t).select(F.col("id").alias("i"))
    # scores with b > i pass threshold i: suffix sums over the (<= n_t + 1)-row bucket table.
    grid = th.join(F.broadcast(hist), th["i"] == hist["b"] - 1, "full") \
        .select(F.coalesce("i", F.col("b") - 1).alias("i"), F.coalesce("pos", F.lit(0)).alias("pos"),
                F.coalesce("neg", F.lit(0)).alias("neg"))
    suffix = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = grid.withColumns({"tp": F.sum("pos").over(suffix), "fp": F.sum("neg").over(suffix)})
    g = attach_scalar(g.where((F.col("i") >= 0) & (F.col("i") < n_t)), totals)
    g = g.withColumns({"threshold": threshold_value(F.col("i"), start, step),
                       "fn": F.col("P") - F.col("tp"),
                       "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
                       "recall": _ratio(F.col("tp"), F.col("P"))})
    g = g.withColumn("f1", F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(_f1(F.col("precision"), F.col("recall"))))
    best = Window.orderBy(F.col("f1").desc(), F.col("i").asc())
    g = g.withColumn("is_best", F.row_number().over(best) == 1)
    return g.select(F.col("i").alias("threshold_index"), X.np_round(F.col("threshold"), 2).alias("threshold"),
                    "tp", "fp", "fn", X.np_round(F.col("f1"), 6).alias("f1"), "is_best")


def binary_metrics(scored: DataFrame, threshold: Column) -> DataFrame:
    """VA13: accuracy, balanced accuracy, precision, recall, F1 (0 when undefined)."""
    pred = (F.col("score") >= threshold).cast("int")
    a = scored.agg(F.count_if((pred == 1) & (F.col("y") == 1)).alias("tp"),
                   F.count_if((pred == 1) & (F.col("y") == 0)).alias("fp"),
                   F.count_if((pred == 0) & (F.col("y") == 1)).alias("fn"),
                   F.count_if((pred == 0) & (F.col("y") == 0)).alias("tn"))
    a = a.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
                       "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
                       "specificity": _ratio(F.col("tn"), F.col("tn") + F.col("fp"))})
    return a.select("tp", "fp", "fn", "tn",
                    X.np_round(_ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
                               6).alias("accuracy"),
                    X.np_round((F.col("recall") + F.col("specificity")) / 2, 6).alias("balanced_accuracy"),
                    X.np_round(F.col("precision"), 6).alias("precision"),
                    X.np_round(F.col("recall"), 6).alias("recall"),
                    X.np_round(_f1(F.col("precision"), F.col("recall")), 6).alias("f1"))


def average_precision(scored: DataFrame) -> DataFrame:
    """VA14: step-wise average precision, tied scores grouped."""
    hist = scored.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    r = rank_rows(hist, [], ["score desc"], ["pos", "neg"], rank_col="_k")
    r = r.withColumns({"ctp": F.col("before_pos") + F.col("pos"), "cfp": F.col("before_neg") + F.col("neg")})
    terms = r.select((F.col("pos").cast("double") * (F.col("ctp") / (F.col("ctp") + F.col("cfp")))).alias("t"),
                     "pos")
    a = terms.agg(F.sum("t").alias("s"), F.sum("pos").alias("P"))
    return a.select(X.np_round(_ratio(F.col("s"), F.col("P")), 6).alias("average_precision"),
                    F.col("P").alias("positives"))


def fold_profile(split: DataFrame) -> DataFrame:
    """VA18: rows, positives, prevalence and date range per fold."""
    return split.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"),
        X.np_round(F.avg("y"), 4).alias("positive_share"),
        F.min("start_datetime").alias("first_start"), F.max("start_datetime").alias("last_start"))
