"""Registered queries: evidence, brief records and map data (EV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadcast.operators import cleaning
from roadcast.operators import evidence as EV
from roadcast.plans import context as ctx
from roadcast.plans import oracle as O
from roadcast.plans.q_deploy import advisory_df
from roadcast.plans.q_forecast import forecast_df
from roadcast.plans.registry import register

W = O.with_ctes
FC_CTES = O.FORECAST_CTES

EVIDENCE_SQL = W(FC_CTES + [
    ("ev_c", "select event_cause, count(*) as n, max(start_datetime_ist) as newest from clean "
             "where event_cause is not null group by event_cause"),
    ("ev_p", "select corridor, event_cause, count(*) as n, max(start_datetime_ist) as newest from clean "
             "where event_cause is not null and corridor is not null group by corridor, event_cause")], """
select f.incident_id, f.match_level,
  coalesce(case when f.match_level = 'fine' then p.n else c.n end, 0) as evidence_rows,
  case when f.match_level = 'fine' then p.newest else c.newest end as newest_evidence
from fc f left join ev_c c on c.event_cause = f.event_cause
left join ev_p p on p.corridor = f.match_corridor and p.event_cause = f.event_cause""")

TOPK_CTES = FC_CTES + [
    ("rk_c", "select *, row_number() over (partition by event_cause order by start_datetime_ist desc, id) as evidence_rank "
             "from clean where event_cause is not null"),
    ("rk_p", "select *, row_number() over (partition by corridor, event_cause order by start_datetime_ist desc, id) "
             "as evidence_rank from clean where event_cause is not null and corridor is not null"),
    ("topk", """
select f.incident_id, f.match_level, r.id, r.evidence_rank, r.start_datetime_ist, r.event_cause, r.corridor, r.priority,
  r.requires_road_closure, r.duration_minutes, r.police_station, r.junction
from fc f join rk_p r on f.match_level = 'fine' and r.corridor = f.match_corridor and r.event_cause = f.event_cause
  and r.evidence_rank <= 20
union all
select f.incident_id, f.match_level, r.id, r.evidence_rank, r.start_datetime_ist, r.event_cause, r.corridor, r.priority,
  r.requires_road_closure, r.duration_minutes, r.police_station, r.junction
from fc f join rk_c r on f.match_level <> 'fine' and r.event_cause = f.event_cause and r.evidence_rank <= 20""")]

VALID_CTES = O.BASE_CTES + [("valid", """
select *, try_cast(latitude as double) as lat, try_cast(longitude as double) as lon from clean
where try_cast(latitude as double) between 12.7::double and 13.3::double
  and try_cast(longitude as double) between 77.3::double and 77.9::double""")]


def _top(spark, sf_dir, k=20):
    return EV.evidence_top_k(forecast_df(spark, sf_dir), ctx.clean(spark, sf_dir), k)


def _brief(spark, sf_dir):
    return EV.brief_lists(forecast_df(spark, sf_dir), ctx.clean(spark, sf_dir), 8)


@register("evidence", EVIDENCE_SQL)
def evidence(spark, sf_dir):
    """EV1: evidence row count (cause, or corridor+cause at fine) and newest time."""
    s = EV.evidence_summary(forecast_df(spark, sf_dir), ctx.clean(spark, sf_dir))
    return s.select("incident_id", "match_level", "evidence_rows", "newest_evidence")


@register("evidence_top20", W(TOPK_CTES, """
select incident_id, match_level, id, evidence_rank, start_datetime_ist, event_cause, corridor, priority,
  requires_road_closure, round(duration_minutes, 6) as duration_minutes, police_station, junction from topk"""))
def evidence_top20(spark, sf_dir):
    """EV2: newest 20 evidence rows per incident (pre-ranked history, broadcast)."""
    return _top(spark, sf_dir).select(
        "incident_id", "match_level", "id", "evidence_rank", "start_datetime_ist", "event_cause", "corridor",
        "priority", "requires_road_closure", F.round("duration_minutes", 6).alias("duration_minutes"),
        "police_station", "junction")


@register("brief_evidence")
def brief_evidence(spark, sf_dir):
    """EV3: top 8 rows per incident as ARRAY<STRUCT> (rows-only)."""
    return EV.incident_evidence(_brief(spark, sf_dir))


@register("brief_records")
def brief_records(spark, sf_dir):
    """EV4: nested printable-brief record per incident (rows-only)."""
    return EV.brief_records(advisory_df(spark, sf_dir, EV.with_evidence(_brief(spark, sf_dir))))


def _valid(spark, sf_dir):
    return cleaning.geo_valid(ctx.clean(spark, sf_dir))


@register("evidence_centre", W(VALID_CTES, f"""
select {O.rnd('avg(lat)', 6)} as centre_lat, {O.rnd('avg(lon)', 6)} as centre_lon, count(*) as points from valid"""))
def evidence_centre(spark, sf_dir):
    """EV5: mean position of valid points."""
    return EV.evidence_centre(_valid(spark, sf_dir))


@register("density_grid", W(VALID_CTES, """
select floor(lat / 0.01::double)::bigint as cell_lat, floor(lon / 0.01::double)::bigint as cell_lon, count(*) as points
from valid group by all"""))
def density_grid(spark, sf_dir):
    """EV6: point density per 0.01-degree cell."""
    return EV.density_grid(_valid(spark, sf_dir))


@register("marker_points", W(VALID_CTES, f"""
select id, lat, lon, start_datetime_ist, {O.SEV_DUR.format(m='duration_minutes')} as severity_proxy
from valid order by start_datetime_ist desc, id limit 300"""))
def marker_points(spark, sf_dir):
    """EV7: newest 300 valid points with severity-proxy class."""
    return EV.marker_points(_valid(spark, sf_dir))
