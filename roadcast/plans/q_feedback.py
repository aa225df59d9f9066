"""Registered queries: verified outcomes and baseline refresh (FB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadcast.operators import baseline as BL
from roadcast.operators import feedback as FB
from roadcast.operators import forecast as FCO
from roadcast.operators import match as MT
from roadcast.plans import context as ctx
from roadcast.plans import oracle as O
from roadcast.plans.registry import register

W = O.with_ctes

FB_NORM = """
select log_seq, logged_at as ts_logged, event_datetime, event_cause,
  case when corridor is null or trim(corridor) = '' or lower(trim(corridor)) = 'unknown' then 'Non-corridor'
       else trim(corridor) end as corridor,
  coalesce(lower(trim(actual_requires_road_closure)) in ('true', '1', 'yes', 'y', 'closed'), false)
    as actual_requires_road_closure,
  case when lower(trim(coalesce(verification_status, 'unverified'))) in ('verified', 'unverified', 'disputed')
       then lower(trim(coalesce(verification_status, 'unverified'))) else 'unverified' end as verification_status,
  coalesce(priority, 'Unknown') as priority, coalesce(verified_by, '') as verified_by,
  try_cast(actual_duration_minutes as double) as actual_duration_minutes
from feedback
"""
ISO = ("case when event_datetime is null then '' else strftime(event_datetime, '%Y-%m-%dT%H:%M:%S') || "
       "case when epoch_us(event_datetime) % 1000000 <> 0 then '.' || lpad(cast(epoch_us(event_datetime) % 1000000 "
       "as varchar), 6, '0') else '' end end")
FB_KEYED = f"""
select *, sha256(concat_ws('|', {ISO}, lower(trim(coalesce(event_cause, ''))), lower(corridor),
  case when actual_duration_minutes is null or isnan(actual_duration_minutes) then ''
       else printf('%.4f', actual_duration_minutes) end,
  case when actual_requires_road_closure then 'True' else 'False' end, lower(trim(priority)))) as feedback_key
from fb_norm
"""
FB_EVENTS = f"""
select 'feedback:' || feedback_key as id, 'verified_feedback' as event_type, event_cause, corridor, priority,
  actual_requires_road_closure as requires_road_closure, event_datetime as start_datetime,
  case when actual_duration_minutes is not null and not isnan(actual_duration_minutes) and actual_duration_minutes >= 0
       then actual_duration_minutes end as duration_minutes,
  coalesce(actual_duration_minutes is not null and not isnan(actual_duration_minutes) and actual_duration_minutes >= 0,
           false) as has_duration,
  hour(event_datetime) as hour_of_day, isodow(event_datetime) - 1 as day_of_week,
  (isodow(event_datetime) - 1) in (5, 6) as is_weekend,
  {O.HOUR_BUCKET.format(h='hour(event_datetime)')} as hour_bucket
from (select *, row_number() over (partition by feedback_key order by ts_logged, log_seq) as rn
      from fb_keyed where verification_status = 'verified')
where rn = 1 and event_datetime is not null and event_cause is not null
"""
COMBINED = """
select cast(id as varchar) as id, event_type, event_cause, corridor, priority, requires_road_closure, duration_minutes,
  has_duration, hour_of_day, day_of_week, is_weekend, hour_bucket from clean
union all
select id, event_type, event_cause, corridor, priority, requires_road_closure, duration_minutes,
  has_duration, hour_of_day, day_of_week, is_weekend, hour_bucket from fb_events
"""
FB_CTES = O.BASE_CTES + [("feedback", O.FEEDBACK), ("fb_norm", FB_NORM), ("fb_keyed", FB_KEYED),
                         ("fb_events", FB_EVENTS), ("combined", COMBINED)]
REFRESH_CTES = FB_CTES + O.baseline_ctes("clean") + O.baseline_ctes("combined", prefix="r_")
DELTA_CTES = REFRESH_CTES + [
    ("incoming", O.INCOMING), ("feats", O.FEATS),
    ("m_old", O.matched_sql("feats", "")), ("m_new", O.matched_sql("feats", "r_"))]


@register("feedback_normalise", W(FB_CTES, """
select log_seq, event_cause, corridor, actual_duration_minutes, actual_requires_road_closure, priority, verified_by,
  verification_status from fb_norm"""))
def feedback_normalise(spark, sf_dir):
    """FB1/SC6: normalised feedback log."""
    return FB.normalise(ctx.feedback(spark, sf_dir)).select(
        "log_seq", "event_cause", "corridor", "actual_duration_minutes", "actual_requires_road_closure",
        "priority", "verified_by", "verification_status")


@register("feedback_key", W(FB_CTES, "select log_seq, feedback_key from fb_keyed"))
def feedback_key(spark, sf_dir):
    """FB2: sha-256 outcome key."""
    return FB.keyed(ctx.feedback(spark, sf_dir)).select("log_seq", "feedback_key")


@register("feedback_accept", W(FB_CTES, """
select log_seq, feedback_key,
  row_number() over (partition by feedback_key order by ts_logged, log_seq) = 1 as accepted from fb_keyed"""))
def feedback_accept(spark, sf_dir):
    """FB3: submissions in log order; a repeated outcome key is refused."""
    return FB.submissions(ctx.feedback(spark, sf_dir)).select("log_seq", "feedback_key", "accepted")


def _events(spark, sf_dir):
    return FB.feedback_events(ctx.feedback(spark, sf_dir))


@register("feedback_events", W(FB_CTES, """
select id, event_type, event_cause, corridor, priority, requires_road_closure, start_datetime, duration_minutes,
  has_duration, hour_of_day, day_of_week, is_weekend, hour_bucket from fb_events"""))
def feedback_events(spark, sf_dir):
    """FB4: verified outcomes as incident rows."""
    return _events(spark, sf_dir).select(
        "id", "event_type", "event_cause", "corridor", "priority", "requires_road_closure", "start_datetime",
        "duration_minutes", "has_duration", "hour_of_day", "day_of_week", "is_weekend", "hour_bucket")


@register("combined_history", W(FB_CTES, "select * from combined"))
def combined_history(spark, sf_dir):
    """FB5: history + verified outcomes."""
    c = FB.combined_history(ctx.clean(spark, sf_dir), _events(spark, sf_dir))
    return c.select("id", "event_type", "event_cause", "corridor", "priority", "requires_road_closure",
                    "duration_minutes", "has_duration", "hour_of_day", "day_of_week", "is_weekend", "hour_bucket")


def refreshed_grains(spark, sf_dir):
    version = ctx.stored_version(spark, sf_dir)
    return FB.refresh_baseline(version.grains, version.state, _events(spark, sf_dir))[0]


@register("baseline_refreshed", W(REFRESH_CTES, f"""
select {O.BASELINE_SELECT} from r_bl_fine union all select {O.BASELINE_SELECT} from r_bl_coarse"""))
def baseline_refreshed(spark, sf_dir):
    """FB6: refreshed baseline: value counts of the stored version plus the outcomes', for touched groups."""
    return BL.baseline_table(refreshed_grains(spark, sf_dir))


@register("refresh_delta", W(DELTA_CTES, """
select o.incident_id, o.match_level as match_level_before, n.match_level as match_level_after,
  o.evidence_count as evidence_before, n.evidence_count as evidence_after,
  o.median_duration_minutes as median_before, n.median_duration_minutes as median_after,
  o.road_closure_rate as closure_before, n.road_closure_rate as closure_after
from m_old o join m_new n on o.incident_id = n.incident_id"""))
def refresh_delta(spark, sf_dir):
    """FB7: forecast tier before and after the refresh, per incident."""
    old = ctx.baselines(spark, sf_dir)
    new = MT.baselines_from_grains(refreshed_grains(spark, sf_dir))
    inc = ctx.incoming(spark, sf_dir)
    a = FCO.forecast(inc, old).select("incident_id", F.col("match_level").alias("match_level_before"),
                                      F.col("evidence_count").alias("evidence_before"),
                                      F.col("expected_duration_minutes").alias("median_before"),
                                      F.col("road_closure_probability").alias("closure_before"))
    b = FCO.forecast(inc, new).select("incident_id", F.col("match_level").alias("match_level_after"),
                                      F.col("evidence_count").alias("evidence_after"),
                                      F.col("expected_duration_minutes").alias("median_after"),
                                      F.col("road_closure_probability").alias("closure_after"))
    return a.join(b, "incident_id", "full")


#: Of the log, every fifth row is written in the old layout: no status, no verifier, no priority, the entry's time as event time.
OLD_LAYOUT = """
select * replace (
  case when log_seq % 5 = 0 then logged_at else event_datetime end as event_datetime,
  case when log_seq % 5 = 0 then null else priority end as priority, case when log_seq % 5 = 0 then null else verified_by end as verified_by,
  case when log_seq % 5 = 0 then null else verification_status end as verification_status)
from feedback0"""
MIXED_CTES = [*O.BASE_CTES, ("feedback0", O.FEEDBACK), ("feedback", OLD_LAYOUT), ("fb_norm", FB_NORM)]


@register("feedback_mixed_layout", W(MIXED_CTES, """
select event_datetime, event_cause, corridor, actual_duration_minutes, actual_requires_road_closure, priority,
  verified_by, verification_status from fb_norm"""))
def feedback_mixed_layout(spark, sf_dir):
    """SC6/SC7: the log as text in two layouts, the current one also below the older one's header, recovered line by line."""
    from roadcast.sources import feedback_files as FF
    from roadcast.streaming.replay import scratch
    log = ctx.feedback(spark, sf_dir)
    rows = log.select("log_seq", F.col("logged_at").alias("timestamp"), "event_datetime", "event_cause", "corridor",
                      "actual_duration_minutes", "actual_requires_road_closure", "priority", "verified_by",
                      "verification_status")
    path = scratch(spark, "feedback-text")
    FF.write_with_header(rows.where("log_seq % 5 <> 0").drop("log_seq"), f"{path}/appended", FF.OLD_HEADER)
    old = rows.where("log_seq % 5 = 0").withColumnRenamed("actual_requires_road_closure", "requires_road_closure")
    FF.write_with_header(old.select(*FF.OLD_HEADER.split(",")), f"{path}/old", FF.OLD_HEADER)
    back = FB.normalise(FF.read_feedback_text(spark, f"{path}/*"))
    return back.select("event_datetime", "event_cause", "corridor", "actual_duration_minutes",
                       "actual_requires_road_closure", "priority", "verified_by", "verification_status")
