"""Registered queries: chronological benchmarks and metrics (VA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadcast.operators import validate as VA
from roadcast.plans import context as ctx
from roadcast.plans import oracle as O
from roadcast.plans.registry import register

W = O.with_ctes
B = O.BASE_CTES

S80 = """
select *, case when split_pos <= floor(n * 0.8::double) then 'train' else 'test' end as fold
from (select *, row_number() over (order by start_datetime, id) as split_pos, count(*) over () as n
      from clean where has_duration)
"""
S70 = """
select *, case when split_pos <= floor(n * 0.70::double) then 'train'
               when split_pos <= floor(n * 0.85::double) then 'validation' else 'test' end as fold,
  case when coalesce(requires_road_closure, false) then 1 else 0 end as y
from (select *, row_number() over (order by start_datetime, id) as split_pos, count(*) over () as n
      from clean where start_datetime is not null)
"""
FEATS80 = """
select id as incident_id, event_cause, corridor as match_corridor, is_weekend, hour_bucket, requires_road_closure,
  duration_minutes, priority, fold from s80
"""
TRUE_BASE = (f"case when duration_count >= 5 and duration_minutes is not null then "
             f"{O.SEV_DUR.format(m='duration_minutes')} else "
             + O.SEV_SCORE.format(s=O.SCORE.format(
                 r="(case when coalesce(requires_road_closure, false) then 1.0::double else 0.0::double end)",
                 p="priority")) + " end")
LAB = f"""
select *, {O.BUMP.format(flag='requires_road_closure', ok='true', t='(' + TRUE_BASE + ')')} as true_severity
from m80
"""
LAB_CTES = B + [("s80", S80), ("train80", "select * from s80 where fold = 'train'")] \
    + O.baseline_ctes("train80", prefix="t_") + [
    ("feats80", FEATS80), ("m80", O.matched_sql("feats80", "t_")), ("lab0", LAB),
    ("lab", "select * exclude (severity_tier), severity_tier as rule_prediction from (" + O.severity_sql("lab0") + ")")]
TEST_PAIRS = "select true_severity, rule_prediction from lab where fold = 'test'"

S70_CTES = B + [("s70", S70)]
RATE_CTES = S70_CTES + [
    ("rates", "select event_cause, avg(y) as rate from s70 where fold = 'train' group by event_cause"),
    ("glob_rate", "select avg(y) as g from s70 where fold = 'train'"),
    ("scored", "select s.id, s.fold, s.y, s.event_cause, coalesce(r.rate, g.g) as score from s70 s "
               "left join rates r on r.event_cause = s.event_cause, glob_rate g where s.fold <> 'train'"),
    ("th", "select range as i, 0.02::double + range * ((0.02::double + 0.01::double) - 0.02::double) as t "
           "from range(97)"),
    ("sweep0", """
select th.i, th.t, count(*) filter (where s.score >= th.t and s.y = 1) as tp,
  count(*) filter (where s.score >= th.t and s.y = 0) as fp,
  count(*) filter (where s.y = 1) - count(*) filter (where s.score >= th.t and s.y = 1) as fn
from th, (select * from scored where fold = 'validation') s group by th.i, th.t"""),
    ("sweep1", """
select *, case when tp + fp = 0 then 0.0 else tp::double / (tp + fp) end as precision,
  case when tp + fn = 0 then 0.0 else tp::double / (tp + fn) end as recall from sweep0"""),
    ("sweep", """
select *, case when tp = 0 then 0.0 else 2.0::double * precision * recall / (precision + recall) end as f1 from sweep1"""),
    ("best", "select t from sweep order by f1 desc, i limit 1"),
]


def _s80(spark, sf_dir):
    return VA.split_80_20(ctx.clean(spark, sf_dir))


def _s70(spark, sf_dir):
    return VA.split_70_15_15(ctx.clean(spark, sf_dir))


def _labels(spark, sf_dir):
    return VA.labelled(_s80(spark, sf_dir))


def _test_pairs(spark, sf_dir):
    return _labels(spark, sf_dir).where(F.col("fold") == "test")


@register("split_80_20", W(B + [("s80", S80)], "select id, start_datetime, fold from s80"))
def split_80_20(spark, sf_dir):
    """VA1: chronological 80/20 split of has-duration rows by exact boundaries."""
    return _s80(spark, sf_dir).select("id", "start_datetime", "fold")


@register("split_70_15_15", W(S70_CTES, "select id, start_datetime, fold, y from s70"))
def split_70_15_15(spark, sf_dir):
    """VA2: chronological 70/15/15 split with the closure label."""
    return _s70(spark, sf_dir).select("id", "start_datetime", "fold", "y")


@register("split_positions", W(B + [("s80", S80)], "select id, split_pos from s80"))
def split_positions(spark, sf_dir):
    """VA1: the rank that the 80/20 split cuts (two-level global rank)."""
    return VA.split_positions(ctx.clean(spark, sf_dir).where(F.col("has_duration")))


@register("true_severity", W(LAB_CTES, "select incident_id, fold, match_level, duration_count, true_severity from lab"))
def true_severity(spark, sf_dir):
    """VA3/VA4: true severity label with train-only reliability."""
    return _labels(spark, sf_dir).select("incident_id", "fold", "match_level", "duration_count", "true_severity")


@register("rule_predictions", W(LAB_CTES, """
select incident_id, true_severity, rule_prediction from lab where fold = 'test'"""))
def rule_predictions(spark, sf_dir):
    """VA5: rule-based forecast of the test fold from the train-only baseline."""
    return _test_pairs(spark, sf_dir).select("incident_id", "true_severity", "rule_prediction")


@register("corridor_vocab", W(S70_CTES, """
select corridor, count(*) as rows from s70 where fold = 'train' group by corridor order by rows desc, corridor limit 15"""))
def corridor_vocab(spark, sf_dir):
    """VA6: top-15 train corridors (others become 'Other')."""
    return VA.corridor_vocab(_s70(spark, sf_dir).where(F.col("fold") == "train"))


@register("majority_baseline", W(LAB_CTES + [
    ("maj", "select true_severity as majority from (select true_severity, count(*) as n from lab where fold = 'train' "
            "group by true_severity) order by n desc, majority limit 1")], """
select m.majority, count(*) as test_rows,
  round_even(count(*) filter (where l.true_severity = m.majority)::double / count(*) * 1000000.0::double, 0)
    / 1000000.0::double as test_accuracy
from lab l, maj m where l.fold = 'test' group by m.majority"""))
def majority_baseline(spark, sf_dir):
    """VA10: majority class of train, scored on test."""
    lab = _labels(spark, sf_dir)
    maj = VA.majority_label(lab.where(F.col("fold") == "train"), "true_severity")
    t = VA.attach_scalar(lab.where(F.col("fold") == "test"), maj)
    a = t.groupBy("majority").agg(F.count(F.lit(1)).alias("test_rows"),
                                  F.count_if(F.col("true_severity") == F.col("majority")).alias("_hit"))
    from roadcast.functions.expressions import np_round
    return a.select("majority", "test_rows", np_round(F.col("_hit").cast("double") / F.col("test_rows"), 6)
                    .alias("test_accuracy"))


@register("confusion_matrix", W(LAB_CTES, f"""
select true_severity as true_label, count(*) filter (where rule_prediction = 'Low') as Low,
  count(*) filter (where rule_prediction = 'Medium') as Medium, count(*) filter (where rule_prediction = 'High') as High,
  count(*) filter (where rule_prediction = 'Unknown') as Unknown
from ({TEST_PAIRS}) group by true_severity"""))
def confusion_matrix(spark, sf_dir):
    """VA15: rule-based confusion matrix on the test fold (pivot)."""
    return VA.confusion(_test_pairs(spark, sf_dir), "true_severity", "rule_prediction")


def _class_report_sql() -> str:
    r = O.rnd
    return W(LAB_CTES + [
        ("cm", f"select true_severity as t, rule_prediction as p, count(*) as n from ({TEST_PAIRS}) group by all"),
        ("cls", "select t as label from cm union select p from cm"),
        ("per0", """
select c.label, coalesce((select sum(n) from cm where t = c.label), 0) as support,
  coalesce((select sum(n) from cm where p = c.label), 0) as predicted,
  coalesce((select sum(n) from cm where t = c.label and p = c.label), 0) as tp from cls c"""),
        ("per1", """
select *, case when predicted = 0 then 0.0 else tp::double / predicted end as precision,
  case when support = 0 then 0.0 else tp::double / support end as recall from per0"""),
        ("per", "select *, case when precision + recall = 0 then 0.0 else 2.0::double * precision * recall "
                "/ (precision + recall) end as f1 from per1")], f"""
select label, {r('precision', 6)} as precision, {r('recall', 6)} as recall, {r('f1', 6)} as f1, support from per
union all select 'macro avg', {r('avg(precision)', 6)}, {r('avg(recall)', 6)}, {r('avg(f1)', 6)}, sum(support) from per
union all select 'weighted avg', {r('sum(precision * support) / sum(support)', 6)},
  {r('sum(recall * support) / sum(support)', 6)}, {r('sum(f1 * support) / sum(support)', 6)}, sum(support) from per
union all select 'accuracy', {r('sum(tp)::double / sum(support)', 6)}, {r('sum(tp)::double / sum(support)', 6)},
  {r('sum(tp)::double / sum(support)', 6)}, sum(support) from per""")


@register("class_report", _class_report_sql())
def class_report(spark, sf_dir):
    """VA16: per-class precision/recall/F1, macro and weighted averages, accuracy."""
    return VA.class_report(_test_pairs(spark, sf_dir), "true_severity", "rule_prediction")


def _scored(spark, sf_dir):
    return VA.cause_rate_scores(_s70(spark, sf_dir))


@register("cause_rate_scores", W(RATE_CTES, "select id, fold, y, event_cause, score from scored"))
def cause_rate_scores(spark, sf_dir):
    """VA11: train closure rate per cause (global rate for unseen causes)."""
    return _scored(spark, sf_dir)


@register("threshold_sweep", W(RATE_CTES, f"""
select i as threshold_index, {O.rnd('t', 2)} as threshold, tp, fp, fn, {O.rnd('f1', 6)} as f1,
  row_number() over (order by f1 desc, i) = 1 as is_best from sweep"""))
def threshold_sweep(spark, sf_dir):
    """VA12: F1 over thresholds 0.02..0.98 on the validation fold."""
    return VA.threshold_sweep(_scored(spark, sf_dir).where(F.col("fold") == "validation"))


BINARY_SQL = f"""
select tp, fp, fn, tn, {O.rnd('(tp + tn)::double / (tp + fp + fn + tn)', 6)} as accuracy,
  {O.rnd('(case when tp + fn = 0 then 0.0 else tp::double / (tp + fn) end + case when tn + fp = 0 then 0.0 else tn::double / (tn + fp) end) / 2', 6)} as balanced_accuracy,
  {O.rnd('p', 6)} as precision, {O.rnd('r', 6)} as recall,
  {O.rnd('case when p + r = 0 then 0.0 else 2.0::double * p * r / (p + r) end', 6)} as f1
from (select *, case when tp + fp = 0 then 0.0 else tp::double / (tp + fp) end as p,
        case when tp + fn = 0 then 0.0 else tp::double / (tp + fn) end as r
      from (select count(*) filter (where s.score >= b.t and s.y = 1) as tp,
              count(*) filter (where s.score >= b.t and s.y = 0) as fp,
              count(*) filter (where s.score < b.t and s.y = 1) as fn,
              count(*) filter (where s.score < b.t and s.y = 0) as tn
            from scored s, best b where s.fold = 'test'))"""


@register("binary_metrics", W(RATE_CTES, BINARY_SQL))
def binary_metrics(spark, sf_dir):
    """VA13: test-fold metrics of the cause-rate baseline at the tuned threshold."""
    scored = _scored(spark, sf_dir)
    sweep = VA.threshold_sweep(scored.where(F.col("fold") == "validation"))
    best = sweep.where(F.col("is_best")).select(VA.threshold_value(F.col("threshold_index")).alias("_t"))
    test = VA.attach_scalar(scored.where(F.col("fold") == "test"), best)
    return VA.binary_metrics(test, F.col("_t"))


@register("zero_baseline", W(RATE_CTES, BINARY_SQL.replace(
    "from scored s, best b", "from (select 0.0::double as score, y, fold from scored) s, (select 1.0::double as t) b")))
def zero_baseline(spark, sf_dir):
    """VA10: test-fold metrics of never expecting a closure, which a useful model must beat."""
    test = _scored(spark, sf_dir).where(F.col("fold") == "test")
    return VA.binary_metrics(test.withColumn("score", F.lit(0.0)), F.lit(1.0))


@register("average_precision", W(RATE_CTES, f"""
select {O.rnd('sum(pos * ctp::double / (ctp + cfp)) / sum(pos)', 6)} as average_precision, sum(pos) as positives
from (select score, pos, sum(pos) over (order by score desc) as ctp, sum(neg) over (order by score desc) as cfp
      from (select score, sum(y) as pos, sum(1 - y) as neg from scored where fold = 'test' group by score))"""))
def average_precision(spark, sf_dir):
    """VA14: average precision of the cause-rate scores on the test fold."""
    return VA.average_precision(_scored(spark, sf_dir).where(F.col("fold") == "test"))


@register("fold_profile", W(S70_CTES, f"""
select fold, count(*) as rows, sum(y) as positives, {O.rnd('avg(y)', 4)} as positive_share,
  min(start_datetime) as first_start, max(start_datetime) as last_start from s70 group by fold"""))
def fold_profile(spark, sf_dir):
    """VA18: rows, positives, prevalence and date range per fold."""
    return VA.fold_profile(_s70(spark, sf_dir))


METRIC_NAMES = ["tp", "fp", "fn", "tn", "accuracy", "balanced_accuracy", "precision", "recall", "f1"]


@register("metric_report", W(RATE_CTES + [("bm", BINARY_SQL)], "\nunion all ".join(
    f"select 'closure_benchmark' as run, 'cause_rate' as model, 'all' as label, '{m}' as metric, "
    f"cast({m} as double) as value from bm" for m in METRIC_NAMES)))
def metric_report(spark, sf_dir):
    """SC10: long-form metric report (run, model, label, metric, value)."""
    from roadcast.sources.sinks import metrics_long
    return metrics_long("closure_benchmark", "cause_rate", binary_metrics(spark, sf_dir))
