"""Registered queries: model features and MLlib models (VA7-VA9, VA17, EX)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadcast.operators import cleaning
from roadcast.operators import experiment as EX
from roadcast.operators import ml as ML
from roadcast.operators import validate as VA
from roadcast.operators.sizing import materialize, spread
from roadcast.plans import context as ctx
from roadcast.plans import oracle as O
from roadcast.plans.q_validate import S70, _labels, _s70
from roadcast.plans.registry import register
from roadcast.sources import adapter
from roadcast.sources.tables import read_table

W = O.with_ctes
B = O.BASE_CTES
MF = B + [("mf", """
select c.*, coalesce(d.text, '') as description, '' as comment from clean c left join documents d on d.doc_id = c.id""")]


def _frame(spark, sf_dir):
    return ML.model_frame(ctx.clean(spark, sf_dir), read_table(spark, sf_dir, "documents"))


def _cyc_sql(col, period):
    return f"{O.rnd(f'%s(2.0::double * pi() * {col}::double / {period}.0::double)', 9)}"


@register("cyclic_features", W(B, f"""
select id, {O.rnd('sin(2.0::double * pi() * hour_of_day::double / 24.0::double)', 9)} as hour_sin,
  {O.rnd('cos(2.0::double * pi() * hour_of_day::double / 24.0::double)', 9)} as hour_cos,
  {O.rnd('sin(2.0::double * pi() * day_of_week::double / 7.0::double)', 9)} as dow_sin,
  {O.rnd('cos(2.0::double * pi() * day_of_week::double / 7.0::double)', 9)} as dow_cos from clean"""))
def cyclic_features(spark, sf_dir):
    """EX1: cyclic hour and weekday encodings (9 dp)."""
    from roadcast.functions.expressions import np_round
    c = ML.cyclic_features(ctx.clean(spark, sf_dir))
    return c.select("id", *[np_round(F.col(x), 9).alias(x) for x in ("hour_sin", "hour_cos", "dow_sin", "dow_cos")])


def _kw_sql():
    text = "lower(concat_ws(' ', description, comment))"
    cols = ", ".join(f"contains({text}, '{t}')::int as {ML.keyword_column(t)}" for t in ML.SEVERITY_TERMS)
    return W(MF, f"select id, {cols} from mf")


@register("keyword_flags", _kw_sql())
def keyword_flags(spark, sf_dir):
    """EX2: 24 keyword flags over the full incident description text."""
    k = ML.keyword_flags(_frame(spark, sf_dir))
    return k.select("id", *[ML.keyword_column(t) for t in ML.SEVERITY_TERMS])


@register("crossed_features", W(B, """
select id, concat_ws('_', corridor, event_cause) as corridor_cause, concat_ws('_', corridor, priority) as corridor_priority,
  concat_ws('_', event_cause, priority) as cause_priority from clean"""))
def crossed_features(spark, sf_dir):
    """EX3: crossed categorical features."""
    return ML.crossed_features(ctx.clean(spark, sf_dir)).select("id", "corridor_cause", "corridor_priority",
                                                                "cause_priority")


@register("severe_label", W(B, """
select id, (coalesce(requires_road_closure, false) or coalesce(duration_minutes >= 60, false))::int as severe_impact
from clean"""))
def severe_label(spark, sf_dir):
    """EX6: severe-impact label."""
    return ML.severe_label(ctx.clean(spark, sf_dir)).select("id", "severe_impact")


@register("target_encoding", W(B + [("s70", S70)], f"""
select event_cause, count(*) as n,
  {O.rnd('(sum(y) + 10.0::double * (select avg(y) from s70 where fold = ' + "'train'" + ')) / (count(*) + 10.0::double)', 6)}
    as encoding
from s70 where fold = 'train' group by event_cause"""))
def target_encoding(spark, sf_dir):
    """EX5: smoothed (m = 10) target encoding of the cause, fitted on train."""
    s = _s70(spark, sf_dir)
    return ML.target_encoding(s.where(F.col("fold") == "train"), "event_cause", "y")


SEVERE = B + [("sev", """
select *, (coalesce(requires_road_closure, false) or coalesce(duration_minutes >= 60, false))::int as severe_impact from clean"""),
    ("split", """
select *, case when row_number() over (partition by severe_impact order by md5(id::varchar || ':42'), id)
  <= floor(count(*) over (partition by severe_impact) * 0.8::double) then 'train' else 'test' end as which from sev""")]


@register("stratified_split", W(SEVERE, "select id, severe_impact, which as fold from split"))
def stratified_split(spark, sf_dir):
    """EX10: seeded 80/20 split within each severe-impact stratum."""
    return EX.stratified_split(ML.severe_label(ctx.clean(spark, sf_dir)), "severe_impact").select("id", "severe_impact", "fold")


def _experiment(spark, sf_dir):
    """EX1-EX6: the experiments' frame, split 80/20 within the severe-impact strata."""
    raw = adapter.raw_incidents_from_events(spread(read_table(spark, sf_dir, "events"), "event_id", "ts"))
    frame = EX.stratified_split(EX.rows(cleaning.clean_incidents(raw), read_table(spark, sf_dir, "documents")), "severe_impact")
    return frame.withColumnRenamed("fold", "which").drop("description", "comment")  # their words are in the keyword columns


def _oof_sql():
    each = " union all ".join(f"select '{c}' as \"column\", {c} as category, fold, severe_impact from folded" for c in EX.CATEGORIES)
    return W(SEVERE + [("folded", """
select *, corridor || '_' || event_cause as corridor_cause, corridor || '_' || priority as corridor_priority, event_cause || '_' || priority as cause_priority
from (select * replace (coalesce(priority, 'Unknown') as priority, coalesce(corridor, 'Non-corridor') as corridor, coalesce(event_cause, 'unknown') as event_cause,
                        coalesce(event_type, 'unplanned') as event_type),
        (('0x' || substr(md5(id::varchar || ':42'), 1, 8))::bigint % 5)::int as fold from split where which = 'train')"""),
        ("long", each), ("asked", "select unnest([0, 1, 2, 3, 4, -1]) as f"), ("cats", 'select distinct "column", category from long')], f"""
select c."column", c.category, a.f as fold, count(l.fold) as n,
  {O.rnd('(coalesce(sum(l.severe_impact), 0) + 10.0::double * (select avg(severe_impact) from folded where fold <> a.f)) / (count(l.fold) + 10.0::double)', 9)} as encoding
from cats c cross join asked a left join long l on l."column" = c."column" and l.category = c.category and l.fold <> a.f group by c."column", c.category, a.f""")


@register("oof_target_encoding", _oof_sql())
def oof_target_encoding(spark, sf_dir):
    """EX5: encodings of all seven categories by severe impact, for each of five folds from the other four (9 dp)."""
    from roadcast.functions.expressions import np_round
    from roadcast.operators.features import fold_of
    frame = EX.stratified_split(ML.severe_label(ML.crossed_features(ML.model_frame(ctx.clean(spark, sf_dir)))), "severe_impact")
    train = frame.where(F.col("fold") == "train").withColumn("fold", fold_of("id", 5, ML.RANDOM_STATE))
    return EX.encodings(train, EX.CATEGORIES, "severe_impact", 5).withColumn("encoding", np_round(F.col("encoding"), 9))


CATEGORICAL = ["event_cause", "corridor_clean", "hour_bucket"]


def _severity_folds(spark, sf_dir):
    lab = _labels(spark, sf_dir).select(F.col("incident_id").alias("id"), "true_severity")
    s80 = VA.split_80_20(ctx.clean(spark, sf_dir)).join(lab, "id")
    vocab = VA.corridor_vocab(s80.where(F.col("fold") == "train"))
    s80 = VA.with_corridor_clean(s80, vocab).withColumns({
        "weekend_int": F.col("is_weekend").cast("int"), "closure_int": F.col("requires_road_closure").cast("int")})
    s80 = materialize(s80.select("id", "fold", "true_severity", *CATEGORICAL, "weekend_int", "closure_int"), "severity-folds")
    return s80.where(F.col("fold") == "train"), s80.where(F.col("fold") == "test")


@register("rf_severity")
def rf_severity(spark, sf_dir):
    """VA7/VA8: 3-class forest (100 trees, depth 8), standard and balanced (rows-only)."""
    train, test = _severity_folds(spark, sf_dir)
    num = ["weekend_int", "closure_int"]
    _, std = ML.random_forest(train, test, CATEGORICAL, num, "true_severity", 100, 8, balanced=False)
    _, bal = ML.random_forest(train, test, CATEGORICAL, num, "true_severity", 100, 8, balanced=True)
    return std.select("id", "true_severity", F.col("predicted").alias("rf_prediction")).join(
        bal.select("id", F.col("predicted").alias("rf_balanced_prediction")), "id")


def _closure_folds(spark, sf_dir):
    s = _s70(spark, sf_dir)
    vocab = VA.corridor_vocab(s.where(F.col("fold") == "train"))
    s = VA.with_corridor_clean(s, vocab).withColumn("weekend_int", F.col("is_weekend").cast("int"))
    return s


@register("rf_closure_scores")
def rf_closure_scores(spark, sf_dir):
    """VA9: balanced forest (300 trees, depth 10) closure probability on validation and test (rows-only)."""
    cats = ["event_cause", "corridor_clean", "event_type", "priority", "hour_bucket"]
    s = materialize(_closure_folds(spark, sf_dir).select("id", "fold", "y", *cats, "weekend_int"), "closure-folds")
    _, scored = ML.random_forest(s.where(F.col("fold") == "train"), s.where(F.col("fold") != "train"), cats,
                                 ["weekend_int"], "y", 300, 10, balanced=True)
    return scored.select("id", "fold", "y", F.col("p_positive").alias("score"))


@register("feature_importances")
def feature_importances(spark, sf_dir):
    """VA17: forest feature importances above 0.0001 (rows-only)."""
    train, test = _severity_folds(spark, sf_dir)
    num = ["weekend_int", "closure_int"]
    model, _ = ML.random_forest(train, test, CATEGORICAL, num, "true_severity", 100, 8, balanced=False)
    return ML.feature_importances(model, train, CATEGORICAL, num)


@register("geo_clusters")
def geo_clusters(spark, sf_dir):
    """EX4: 50 k-means clusters fitted on train coordinates (rows-only)."""
    s = _s70(spark, sf_dir).withColumns({"latitude": F.coalesce(F.col("latitude"), F.lit(0.0)),
                                         "longitude": F.coalesce(F.col("longitude"), F.lit(0.0))})
    return ML.geo_clusters(s.where(F.col("fold") == "train"), s).select("id", "fold", "geo_cluster")


def _regression(spark, sf_dir):
    cats = ["event_cause", "corridor_clean", "priority", "hour_bucket"]
    s = _closure_folds(spark, sf_dir).withColumn("closure_int", F.col("y"))
    s = materialize(s.select("id", "fold", "event_type", "duration_minutes", *cats, "weekend_int", "closure_int"), "timed-folds")
    return ML.duration_regression(s.where(F.col("fold") == "train"), s.where(F.col("fold") != "train"), cats,
                                  ["weekend_int", "closure_int"])


@register("duration_regression")
def duration_regression(spark, sf_dir):
    """EX7: boosted-tree duration model per event type (rows-only)."""
    return _regression(spark, sf_dir)


@register("regression_metrics")
def regression_metrics(spark, sf_dir):
    """EX13: R-squared and MAE of the duration model (rows-only: depends on the fitted model)."""
    return ML.regression_metrics(_regression(spark, sf_dir))


CLOSURE_CATS = ["event_cause", "corridor_clean", "event_type", "priority", "hour_bucket"]


@register("soft_vote")
def soft_vote(spark, sf_dir):
    """EX9: soft-vote severe-impact score of three classifiers on the test fold (rows-only)."""
    return ML.soft_vote(EX.table(_experiment(spark, sf_dir), F.col("severe_impact")))


@register("cv_tuning")
def cv_tuning(spark, sf_dir):
    """EX11: cross-validated grid of boosted trees for severe impact (rows-only)."""
    return ML.cv_tuning(EX.table(_experiment(spark, sf_dir).where(F.col("which") == "train"), F.col("severe_impact")))


@register("oof_threshold")
def oof_threshold(spark, sf_dir):
    """EX12: F1 over thresholds 0.05..0.94 on out-of-fold soft-vote scores of the train fold (rows-only)."""
    scored = ML.out_of_fold_scores(EX.table(_experiment(spark, sf_dir).where(F.col("which") == "train"), F.col("severe_impact")))
    return VA.threshold_sweep(materialize(scored), 0.05, 0.95)


@register("stacked_regression")
def stacked_regression(spark, sf_dir):
    """EX8: stacked duration regressors, planned and unplanned apart, on the test fold (rows-only)."""
    timed = materialize(_experiment(spark, sf_dir).where(F.col("duration_minutes").isNotNull()), "timed")
    tables = [EX.table(timed.where(F.col("event_type") == t), F.log1p("duration_minutes"), ["event_type", "duration_minutes"])
              for t in ("planned", "unplanned")]
    return ML.stacked_regression(tables)


@register("model_export")
def model_export(spark, sf_dir):
    """EX14/SC9: 3-class severity model of all rows with a duration, saved as a pipeline, reloaded and applied (rows-only)."""
    from roadcast.streaming.replay import scratch
    whole = ctx.clean(spark, sf_dir).where(F.col("has_duration")).withColumn("fold", F.lit("train"))
    labels = VA.labelled(whole).select(F.col("incident_id").alias("id"), "true_severity")
    rows = VA.with_corridor_clean(whole, VA.corridor_vocab(whole)).withColumns({
        "weekend_int": F.col("is_weekend").cast("int"), "closure_int": F.col("requires_road_closure").cast("int")})
    rows = materialize(rows.select("id", *CATEGORICAL, "weekend_int", "closure_int").join(labels, "id"), "severity-rows")
    model = ML.export_model(rows, CATEGORICAL, ["weekend_int", "closure_int"], scratch(spark, "severity-model"), "true_severity")
    return model.transform(rows).select("id", "true_severity", "predicted")


@register("model_lift")
def model_lift(spark, sf_dir):
    """VA18: forest vs cause-rate lift (F1, PR-AUC) and balanced-vs-standard Medium recall (rows-only)."""
    from roadcast.plans.q_validate import _scored

    def tuned(scored):
        sweep = VA.threshold_sweep(scored.where(F.col("fold") == "validation"))
        best = sweep.where(F.col("is_best")).select(VA.threshold_value(F.col("threshold_index")).alias("_t"))
        test = scored.where(F.col("fold") == "test")
        m = VA.binary_metrics(VA.attach_scalar(test, best), F.col("_t")).select("f1")
        ap = VA.average_precision(test).select(F.col("average_precision").alias("pr_auc"))
        return VA.attach_scalar(m, ap)

    # Model outputs are checkpointed once: the forests are not re-applied per metric.
    rf = tuned(materialize(rf_closure_scores(spark, sf_dir)))
    base = tuned(materialize(_scored(spark, sf_dir)))
    lift = VA.attach_scalar(rf.select(F.col("f1").alias("rf_f1"), F.col("pr_auc").alias("rf_pr_auc")),
                            base.select(F.col("f1").alias("base_f1"), F.col("pr_auc").alias("base_pr_auc")))
    sev = materialize(rf_severity(spark, sf_dir))
    std = VA.class_report(sev, "true_severity", "rf_prediction").where(F.col("label") == "Medium")
    bal = VA.class_report(sev, "true_severity", "rf_balanced_prediction").where(F.col("label") == "Medium")
    recall = VA.attach_scalar(std.select(F.col("recall").alias("std_recall")),
                              bal.select(F.col("recall").alias("bal_recall")))
    out = VA.attach_scalar(lift, recall)
    return out.select(
        F.expr("stack(3, 'f1', base_f1, rf_f1, rf_f1 - base_f1, 'pr_auc', base_pr_auc, rf_pr_auc, "
               "rf_pr_auc - base_pr_auc, 'medium_recall', std_recall, bal_recall, bal_recall - std_recall) "
               "as (metric, reference, candidate, lift)"))
