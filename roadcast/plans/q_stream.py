"""Registered queries: incident replay and streams (ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadcast.operators import baseline as BL
from roadcast.plans import context as ctx
from roadcast.plans import oracle as O
from roadcast.plans.q_deploy import BARRICADE, PERSONNEL, REC_CTES
from roadcast.plans.q_feedback import REFRESH_CTES
from roadcast.plans.registry import register
from roadcast.streaming import ordered as OR
from roadcast.streaming import replay as RP

W = O.with_ctes

REPLAY_IN = """
select id as incident_id, start_datetime_ist as planned_start, event_cause,
  case when corridor = 'Non-corridor' then null else corridor end as corridor,
  coalesce(requires_road_closure, false) as requires_road_closure
from clean where start_datetime_ist is not null order by start_datetime_ist desc, id desc limit 15
"""
REPLAY_CTES = O.BASE_CTES + O.baseline_ctes() + [
    ("incoming", REPLAY_IN), ("feats", O.FEATS), ("matched", O.matched_sql()), ("fc", O.severity_sql("matched")),
    ("rec", f"select *, {PERSONNEL} as recommended_personnel_count, {BARRICADE} as barricade_recommended from fc"),
    ("rp", """
select row_number() over (order by planned_start, incident_id) as replay_order, incident_id, planned_start,
  event_cause, match_corridor as corridor, match_level, severity_tier, recommended_personnel_count,
  barricade_recommended from rec""")]
RP_COLS = ("replay_order, incident_id, planned_start, event_cause, corridor, match_level, severity_tier, "
           "recommended_personnel_count, barricade_recommended")


def _replayed(spark, sf_dir):
    return RP.replay_batch(ctx.clean(spark, sf_dir))


@register("replay_batch", W(REPLAY_CTES, f"select {RP_COLS} from rp"))
def replay_batch(spark, sf_dir):
    """ST1: newest 15 incidents replayed oldest-first through forecast + recommendation."""
    return _replayed(spark, sf_dir).select(*[c.strip() for c in RP_COLS.split(",")])


@register("replay_latest8", W(REPLAY_CTES, f"select {RP_COLS} from rp order by replay_order desc limit 8"))
def replay_latest8(spark, sf_dir):
    """ST3: rolling feed - the latest 8 scored incidents of the replay."""
    r = _replayed(spark, sf_dir)
    return r.orderBy(F.col("replay_order").desc()).limit(8).select(*[c.strip() for c in RP_COLS.split(",")])


@register("replay_gaps", W(REPLAY_CTES, """
select replay_order, incident_id, planned_start,
  greatest(0.0::double, (epoch_us(planned_start) - epoch_us(lag(planned_start) over (order by replay_order)))::double
    / 3600000000.0::double) as gap_hours from rp"""))
def replay_gaps(spark, sf_dir):
    """ST4: hours between successive replayed incidents."""
    return RP.replay_gaps(_replayed(spark, sf_dir))


@register("replay_stream", W(REC_CTES, """
select incident_id, planned_start, event_cause, match_corridor as corridor, match_level, severity_tier,
  recommended_personnel_count, barricade_recommended from rec"""))
def replay_stream(spark, sf_dir):
    """ST2: the incoming incidents scored by a Structured Streaming query (availableNow)."""
    scored, _ = RP.replay_stream(spark, ctx.incoming(spark, sf_dir), ctx.clean(spark, sf_dir))
    return scored


@register("replay_ordered", W(REC_CTES, """
select incident_id, planned_start, severity_tier, recommended_personnel_count,
  (rank() over (order by planned_start) - 1)::bigint as earlier,
  greatest(0.0::double, (epoch_us(planned_start) - epoch_us(lag(planned_start) over (order by planned_start, incident_id)))::double
    / 3600000000.0::double) as gap_hours
from rec where planned_start is not null"""))
def replay_ordered(spark, sf_dir):
    """ST2/ST4: all incidents streamed out of order; event-time state gives each its place and the gap before it."""
    scored = RP.score_incidents(ctx.incoming(spark, sf_dir), ctx.baselines(spark, sf_dir))
    times = OR.ordered_times(spark, ctx.incoming(spark, sf_dir), RP.scratch(spark, "ordered"))
    return OR.in_time_order(scored, times).select("incident_id", "planned_start", "severity_tier", "recommended_personnel_count",
                                                  "earlier", "gap_hours")


@register("feedback_stream", W(REFRESH_CTES, f"""
select {O.BASELINE_SELECT} from r_bl_fine union all select {O.BASELINE_SELECT} from r_bl_coarse"""))
def feedback_stream(spark, sf_dir):
    """ST5: baseline after folding the feedback stream batch by batch (last version, BL4 rows)."""
    grains = RP.feedback_stream(spark, ctx.feedback(spark, sf_dir), ctx.clean(spark, sf_dir))
    return BL.baseline_table(grains)
