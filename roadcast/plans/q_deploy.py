"""Registered queries: deployment and advisory (DP, AD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.operators import baseline as BL
from roadcast.operators import deploy as DP
from roadcast.plans import context as ctx
from roadcast.plans import oracle as O
from roadcast.plans.q_forecast import forecast_df
from roadcast.plans.registry import register

W = O.with_ctes

HARD = "coalesce(requires_road_closure, false)"
PERSONNEL = (f"(case when severity_tier = 'Low' and not {HARD} then 2 when severity_tier = 'Low' and {HARD} then 4 "
             f"when severity_tier = 'Medium' and not {HARD} then 4 when severity_tier = 'Medium' and {HARD} then 6 "
             f"when severity_tier = 'High' and not {HARD} then 6 when severity_tier = 'High' and {HARD} then 10 "
             f"when {HARD} then 6 else 4 end + case when not {HARD} and coalesce(road_closure_probability >= 0.40::double, false) "
             f"then 2 else 0 end)")
BARRICADE = ("(severity_tier in ('Medium', 'High') or coalesce(road_closure_probability >= 0.25::double, false) "
             "or requires_road_closure is not distinct from true)")
LOCATION = ("case when junction is not null and lower(trim(junction)) not in ('', 'unknown') then junction || ' junction' "
            "when address is not null and trim(address) <> '' then 'near ' || substr(address, 1, 80) "
            "when corridor is not null and lower(trim(corridor)) not in ('', 'non-corridor') then 'along ' || corridor "
            "else 'near event start location (coordinates available in ASTRAM record)' end")
REC_CTES = O.FORECAST_CTES + [("rec", f"""
select *, {PERSONNEL} as recommended_personnel_count, {BARRICADE} as barricade_recommended,
  {LOCATION} as barricade_location_hint from fc""")]

HAS_WIN = "(expected_duration_minutes is not null and expected_duration_minutes <> 0)"
END_TS = "(planned_start + to_microseconds(round(expected_duration_minutes * 60000000.0::double)::bigint))"
CORR_UP = "case when corridor is not null and corridor <> '' then upper(corridor) else 'ROAD' end"
VMS_TIME = (f"case when {HAS_WIN} then strftime(planned_start, '%I:%M%p') || '-' || strftime({END_TS}, '%I:%M%p') "
            f"else 'FROM ' || strftime(planned_start, '%I:%M%p') end")
VMS_RAW = (f"case when barricade_recommended or {HARD} then 'DIVERSION: ' || {CORR_UP} || ' CLOSED ' || {VMS_TIME} "
           f"|| '. SEEK ALTERNATE ROUTE' else 'ALERT: ' || upper(replace(event_cause, '_', ' ')) || ' ON ' || {CORR_UP} "
           f"|| ' ' || {VMS_TIME} || '. EXPECT DELAYS.' end")
VMS = f"upper(case when length({VMS_RAW}) > 100 then substr({VMS_RAW}, 1, 97) || '...' else {VMS_RAW} end)"


RATE = "format('{:.0f}%', road_closure_probability * 100)"
LIKELY = "coalesce(road_closure_probability >= 0.40::double, false)"
PLACE = "coalesce(nullif(corridor, ''), 'Non-corridor')"
_BASIS = (f"case when severity_basis = 'duration' then {O.literal(C.RATIONALE_BY_DURATION)} when expected_duration_minutes is not null "
          f"then {O.literal(C.RATIONALE_BY_CLOSURE.replace('{figure}', C.RATIONALE_FIGURE))} "
          f"else {O.literal(C.RATIONALE_BY_CLOSURE.replace('{figure}', ''))} end")
_CLOSURE = (f"case when requires_road_closure is not distinct from true then {O.literal(C.RATIONALE_CLOSURE_CONFIRMED)} "
            f"when {LIKELY} then {O.literal(C.RATIONALE_CLOSURE_LIKELY)} else '' end")
_BARRIER = f"case when barricade_recommended then {O.literal(C.RATIONALE_BARRICADE)} else {O.literal(C.RATIONALE_NO_BARRICADE)} end"
RATIONALE = O.filled(f"({O.literal(C.RATIONALE_OPENING)} || {_BASIS} || {O.literal(C.RATIONALE_CONFIDENCE)} || {_CLOSURE} || "
                     f"{O.literal(C.RATIONALE_OFFICERS)} || {_BARRIER})", {
    "length": f"case when expected_duration_minutes is null then {O.literal(C.RATIONALE_NO_LENGTH)} else {O.literal(C.RATIONALE_LENGTH)} end",
    "place": f"case when corridor is not null and lower(corridor) not in ('non-corridor', 'none', '') then {O.literal(C.RATIONALE_PLACE)} else '' end",
    "evidence": "evidence_count", "timed": "duration_count", "tier": "severity_tier",
    "minutes": "coalesce(format('{:.0f}', expected_duration_minutes), '')", "rate": f"coalesce({RATE}, 'unknown')",
    "officers": "recommended_personnel_count", "confidence": "confidence_label", "cause": "replace(event_cause, '_', ' ')",
    "corridor": "coalesce(corridor, '')"})
SOFT_NOTE = O.filled(O.literal(C.SOFT_BUMP_NOTE), {"extra": "2", "rate": RATE, "threshold": "40"})
WINDOW = (f"case when {HAS_WIN} then strftime(planned_start, '%I:%M %p') || ' to ' || strftime({END_TS}, '%I:%M %p') "
          "else 'starting at ' || strftime(planned_start, '%I:%M %p') end")
EVENT_TITLE = "array_to_string(list_transform(string_split(event_cause, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
TITLE = O.filled(O.literal(C.ADVISORY_TITLE), {"date": "strftime(planned_start, '%Y-%m-%d')", "event": EVENT_TITLE, "place": PLACE})
ADVISORY = O.filled(O.literal(C.ADVISORY_LAYOUT), {
    "movement": f"case when barricade_recommended or {HARD} then {O.literal(C.ADVISORY_CLOSED)} else {O.literal(C.ADVISORY_OPEN)} end",
    "staff": O.literal(C.ADVISORY_STAFF), "rule": f"repeat('=', length({TITLE}))", "window": WINDOW,
    "officers": "recommended_personnel_count",
    "station": (f"case when corridor is not null and corridor not in ('', 'Non-corridor') and beat is not null "
                f"then beat || ' Traffic Police Station' else {O.literal(C.DEFAULT_STATION)} end"),
    "title": TITLE, "sign": VMS, "place": PLACE})
#: The most frequent station of each corridor, the first of them by name.
BEATS = """
select corridor as beat_corridor, police_station as beat from (
  select corridor, police_station, row_number() over (partition by corridor order by count(*) desc, police_station) as rn
  from clean where corridor is not null and police_station is not null group by corridor, police_station) where rn = 1
"""


def recommend_df(spark, sf_dir, with_text=True):
    return DP.recommend(forecast_df(spark, sf_dir), with_text=with_text)


def advisory_df(spark, sf_dir, fc=None):
    """Advisories of all forecasts; ``fc``: the forecasts with further columns, which stay."""
    stations = BL.station_by_corridor(ctx.clean(spark, sf_dir))
    return DP.advisory(recommend_df(spark, sf_dir) if fc is None else DP.recommend(fc), stations)


@register("personnel", W(REC_CTES, """
select incident_id, severity_tier, road_closure_probability, requires_road_closure, recommended_personnel_count from rec"""))
def personnel(spark, sf_dir):
    """DP1/DP2: officers by tier and closure flag, +2 above 40% closure rate."""
    return recommend_df(spark, sf_dir, False).select(
        "incident_id", "severity_tier", "road_closure_probability", "requires_road_closure",
        "recommended_personnel_count")


@register("barricade", W(REC_CTES, "select incident_id, severity_tier, barricade_recommended from rec"))
def barricade(spark, sf_dir):
    """DP3: barricade decision."""
    return recommend_df(spark, sf_dir, False).select("incident_id", "severity_tier", "barricade_recommended")


@register("barricade_location", W(REC_CTES, "select incident_id, barricade_location_hint from rec"))
def barricade_location(spark, sf_dir):
    """DP4: junction -> address -> corridor -> generic hint."""
    return recommend_df(spark, sf_dir, False).select("incident_id", "barricade_location_hint")


@register("recommend_batch", W(REC_CTES, """
select incident_id, severity_tier, match_level, recommended_personnel_count, barricade_recommended,
  barricade_location_hint from rec"""))
def recommend_batch(spark, sf_dir):
    """DP7: batch recommendation (numeric part checked by the oracle)."""
    return recommend_df(spark, sf_dir, False).select(
        "incident_id", "severity_tier", "match_level", "recommended_personnel_count", "barricade_recommended",
        "barricade_location_hint")


@register("rationale", W(REC_CTES, f"""
select incident_id, {RATIONALE} as rationale, {O.literal(C.DIVERSION_DISCLAIMER)} as diversion_suggestion,
  case when not {HARD} and {LIKELY} then {SOFT_NOTE} else '' end as recommendation_notes from rec"""))
def rationale(spark, sf_dir):
    """DP5/DP6: rationale paragraph, diversion disclaimer and notes (joined by line ends)."""
    return recommend_df(spark, sf_dir).select("incident_id", "rationale", "diversion_suggestion",
                                               F.array_join("recommendation_notes", "\n").alias("recommendation_notes"))


@register("advisory_window", W(REC_CTES, f"""
select incident_id, case when {HAS_WIN} then strftime(planned_start, '%I:%M %p') || ' to ' || strftime({END_TS}, '%I:%M %p')
  else 'starting at ' || strftime(planned_start, '%I:%M %p') end as time_range from rec"""))
def advisory_window(spark, sf_dir):
    """AD1: advisory time window text."""
    return DP.advisory_window(forecast_df(spark, sf_dir)).select("incident_id", "time_range")


@register("vms_message", W(REC_CTES, f"select incident_id, {VMS} as vms_message from rec"))
def vms_message(spark, sf_dir):
    """AD2: sign-board message."""
    r = recommend_df(spark, sf_dir, False)
    return r.select("incident_id", DP.vms_message(r).alias("vms_message"))


@register("advisory_batch", W(REC_CTES + [("beats", BEATS)], f"""
select incident_id, {ADVISORY} as advisory_text from rec left join beats on corridor = beat_corridor"""))
def advisory_batch(spark, sf_dir):
    """AD3: advisory text block per incident."""
    return advisory_df(spark, sf_dir).select("incident_id", "advisory_text")


@register("extract_vms", W(REC_CTES, f"select incident_id, {VMS} as vms_message from rec"))
def extract_vms(spark, sf_dir):
    """AD4: sign-board message recovered from the generated advisory text."""
    a = advisory_df(spark, sf_dir)
    return a.select("incident_id", DP.extract_vms(F.col("advisory_text")).alias("vms_message"))
