"""Registered queries: baselines, match, forecast (BL, MT, FC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadcast.functions import expressions as X
from roadcast.operators import baseline as BL
from roadcast.operators import forecast as FC
from roadcast.operators import match as MT
from roadcast.plans import context as ctx
from roadcast.plans import oracle as O
from roadcast.plans.registry import register

W = O.with_ctes
B = O.BASE_CTES
BLC = B + O.baseline_ctes()


def _grains(spark, sf_dir):
    return BL.all_grains(ctx.clean(spark, sf_dir))


@register("baseline_fine", W(BLC, f"select {O.BASELINE_SELECT} from bl_fine"))
def baseline_fine(spark, sf_dir):
    """BL1: fine baseline (corridor, cause, weekend, hour band), >= 5 durations."""
    return BL.fine_baseline(BL.all_grains(ctx.clean(spark, sf_dir), ("fine",)))


@register("baseline_coarse", W(BLC, f"select {O.BASELINE_SELECT} from bl_coarse"))
def baseline_coarse(spark, sf_dir):
    """BL2: coarse baseline (cause, weekend, hour band), every group."""
    return BL.coarse_baseline(BL.all_grains(ctx.clean(spark, sf_dir), ("coarse",)))


@register("baseline_cause", W(BLC, """
select event_cause, median_duration_minutes, road_closure_rate, event_count, duration_count, priority_mode
from cause_all"""))
def baseline_cause(spark, sf_dir):
    """BL3: cause baseline over the whole history."""
    return BL.cause_baseline(BL.all_grains(ctx.clean(spark, sf_dir), ("cause",)))


@register("baseline_table", W(BLC, f"select {O.BASELINE_SELECT} from bl_table"))
def baseline_table(spark, sf_dir):
    """BL4: fine + coarse rows, one aggregation pass over both grains."""
    return BL.build_baseline_table(ctx.clean(spark, sf_dir))


@register("baseline_tier_counts", W(BLC, "select match_level, count(*) as rows from bl_table group by match_level"))
def baseline_tier_counts(spark, sf_dir):
    """DQ8: baseline rows per tier."""
    return BL.build_baseline_table(ctx.clean(spark, sf_dir)).groupBy("match_level").agg(
        F.count(F.lit(1)).alias("rows"))


@register("station_by_corridor", W(B, """
select corridor, police_station from (
  select corridor, police_station, row_number() over (partition by corridor order by count(*) desc, police_station) as rn
  from clean where corridor is not null and police_station is not null group by corridor, police_station) where rn = 1"""))
def station_by_corridor(spark, sf_dir):
    """BL6: most frequent station per corridor."""
    return BL.station_by_corridor(ctx.clean(spark, sf_dir))


FEAT_CTES = B + [("incoming", O.INCOMING), ("feats", O.FEATS)]


@register("incoming_features", W(FEAT_CTES, """
select incident_id, match_corridor, hour_of_day, day_of_week, is_weekend, hour_bucket from feats"""))
def incoming_features(spark, sf_dir):
    """MT1: time features and corridor fallback of incoming incidents."""
    return MT.incoming_features(ctx.incoming(spark, sf_dir)).select(
        "incident_id", "match_corridor", "hour_of_day", "day_of_week", "is_weekend", "hour_bucket")


MATCH_CTES = BLC + [("incoming", O.INCOMING), ("feats", O.FEATS), ("matched", O.matched_sql())]


def _matched(spark, sf_dir):
    base = ctx.baselines(spark, sf_dir)
    return MT.tiered_match(MT.incoming_features(ctx.incoming(spark, sf_dir)), base)


@register("match_fine", W(MATCH_CTES, """
select i.incident_id, f.event_count, f.duration_count, f.median_duration_minutes, f.road_closure_rate
from feats i join bl_fine f on f.corridor = i.match_corridor and f.event_cause = i.event_cause
  and f.is_weekend = i.is_weekend and f.hour_bucket = i.hour_bucket"""))
def match_fine(spark, sf_dir):
    """MT2: incoming incidents with a fine match."""
    base = ctx.baselines(spark, sf_dir)
    i = MT.incoming_features(ctx.incoming(spark, sf_dir))
    f = base.fine
    j = i.join(f, (i["match_corridor"] == f["corridor"]) & (i["event_cause"] == f["event_cause"])
               & (i["is_weekend"] == f["is_weekend"]) & (i["hour_bucket"] == f["hour_bucket"]))
    return j.select(i["incident_id"], f["event_count"], f["duration_count"],
                    f["median_duration_minutes"], f["road_closure_rate"])


@register("match_coarse", W(MATCH_CTES, """
select i.incident_id, c.event_count, c.duration_count, c.median_duration_minutes, c.road_closure_rate
from feats i join coarse_all c on c.event_cause = i.event_cause and c.is_weekend = i.is_weekend
  and c.hour_bucket = i.hour_bucket where c.duration_count >= 5"""))
def match_coarse(spark, sf_dir):
    """MT3: incoming incidents with a reliable coarse group (>= 5 durations)."""
    base = ctx.baselines(spark, sf_dir)
    i = MT.incoming_features(ctx.incoming(spark, sf_dir))
    c = base.coarse
    j = i.join(c, (i["event_cause"] == c["event_cause"]) & (i["is_weekend"] == c["is_weekend"])
               & (i["hour_bucket"] == c["hour_bucket"]))
    return j.select(i["incident_id"], c["event_count"], c["duration_count"],
                    c["median_duration_minutes"], c["road_closure_rate"])


@register("match_cause_only", W(MATCH_CTES, """
select incident_id, event_cause, evidence_count, duration_count, median_duration_minutes, road_closure_rate
from matched where match_level = 'cause_only'"""))
def match_cause_only(spark, sf_dir):
    """MT4: incidents that fall back to the cause-only tier."""
    return _matched(spark, sf_dir).where(F.col("match_level") == "cause_only").select(
        "incident_id", "event_cause", "evidence_count", "duration_count",
        "median_duration_minutes", "road_closure_rate")


@register("match_no_data", W(MATCH_CTES, """
select distinct i.event_cause from feats i anti join cause_all k on k.event_cause = i.event_cause"""))
def match_no_data(spark, sf_dir):
    """MT5: causes of incoming incidents never seen in history (left_anti)."""
    base = ctx.baselines(spark, sf_dir)
    i = MT.incoming_features(ctx.incoming(spark, sf_dir))
    return i.join(base.cause, "event_cause", "left_anti").select("event_cause").distinct()


@register("tiered_match", W(MATCH_CTES, """
select incident_id, match_level, evidence_count, duration_count, median_duration_minutes,
  road_closure_rate, priority_mode from matched"""))
def tiered_match(spark, sf_dir):
    """MT6: first hit of fine -> coarse -> cause_only -> no_data."""
    return _matched(spark, sf_dir).select("incident_id", "match_level", "evidence_count", "duration_count",
                                          "median_duration_minutes", "road_closure_rate", "priority_mode")


def forecast_df(spark, sf_dir, with_notes=False):
    base = ctx.baselines(spark, sf_dir)
    return FC.forecast(ctx.incoming(spark, sf_dir), base, with_notes=with_notes)


@register("forecast_batch", W(O.FORECAST_CTES, f"select {O.FORECAST_SELECT} from fc"))
def forecast_batch(spark, sf_dir):
    """FC6: batch forecast of every incoming incident."""
    return forecast_df(spark, sf_dir).select(*FC.FORECAST_COLUMNS)


@register("severity_duration", W(O.FORECAST_CTES, """
select incident_id, expected_duration_minutes, severity_tier from fc where severity_basis = 'duration'"""))
def severity_duration(spark, sf_dir):
    """FC2 (+FC4): duration-based tiers."""
    return forecast_df(spark, sf_dir).where(F.col("severity_basis") == "duration").select(
        "incident_id", "expected_duration_minutes", "severity_tier")


@register("severity_closure_priority", W(O.FORECAST_CTES, f"""
select incident_id, road_closure_probability, priority_mode,
  round({O.SCORE.format(r='road_closure_probability', p='priority_mode')}, 4) as closure_priority_score,
  severity_tier from fc where severity_basis = 'closure_priority'"""))
def severity_closure_priority(spark, sf_dir):
    """FC3 (+FC4): closure/priority-based tiers with the score."""
    f = forecast_df(spark, sf_dir).where(F.col("severity_basis") == "closure_priority")
    return f.select("incident_id", "road_closure_probability", "priority_mode",
                    F.round(X.closure_priority_score(F.col("road_closure_probability"), F.col("priority_mode")), 4)
                    .alias("closure_priority_score"), "severity_tier")


@register("severity_bump", W(O.FORECAST_CTES, """
select incident_id, requires_road_closure, severity_basis, severity_tier from fc
where requires_road_closure is not distinct from true"""))
def severity_bump(spark, sf_dir):
    """FC4: tiers of incidents flagged for closure (bumped one step)."""
    return forecast_df(spark, sf_dir).where(F.col("requires_road_closure").eqNullSafe(True)).select(
        "incident_id", "requires_road_closure", "severity_basis", "severity_tier")


@register("confidence_label", W(O.FORECAST_CTES, """
select incident_id, match_level, evidence_count, duration_reliability, confidence_label from fc"""))
def confidence_label(spark, sf_dir):
    """FC5: confidence label text."""
    return forecast_df(spark, sf_dir).select("incident_id", "match_level", "evidence_count",
                                              "duration_reliability", "confidence_label")


@register("forecast_notes")
def forecast_notes(spark, sf_dir):
    """FC7: explanation notes (ARRAY<STRING>), rows-only check."""
    return forecast_df(spark, sf_dir, with_notes=True).select("incident_id", "severity_basis", "notes")


@register("confidence_class", W(O.FORECAST_CTES, """
select incident_id, case when starts_with(confidence_label, 'High') then 'High'
  when starts_with(confidence_label, 'Moderate') then 'Medium'
  when starts_with(confidence_label, 'Low') then 'Low' else 'Insufficient' end as confidence_class from fc"""))
def confidence_class(spark, sf_dir):
    """FC9: short confidence class."""
    return forecast_df(spark, sf_dir).select(
        "incident_id", X.confidence_class(F.col("confidence_label")).alias("confidence_class"))


@register("basis_caption", W(O.FORECAST_CTES, """
select incident_id, case when severity_basis = 'duration' then 'Based on duration history'
  when severity_basis = 'closure_priority' then 'Based on closure rate & priority (limited duration data)'
  else 'Insufficient historical data for duration or closure prediction' end as basis_caption from fc"""))
def basis_caption(spark, sf_dir):
    """FC11: caption by severity basis."""
    return forecast_df(spark, sf_dir).select(
        "incident_id", X.basis_caption(F.col("severity_basis")).alias("basis_caption"))


@register("incident_id", W(FEAT_CTES, """
select incident_id, 'BTP-' || strftime(planned_start, '%Y%m%d%H%M') || '-' ||
  coalesce(nullif(substr(regexp_replace(upper(event_cause), '[^A-Z0-9]', '', 'g'), 1, 6), ''), 'EVENT') as incident_code
from incoming"""))
def incident_id(spark, sf_dir):
    """FC10: printable incident code."""
    i = ctx.incoming(spark, sf_dir)
    return i.select("incident_id", X.incident_code(F.col("event_cause"), F.col("planned_start")).alias("incident_code"))
