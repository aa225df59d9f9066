"""DuckDB SQL fragments that restate each query independently.

Used only to check the Spark jobs: the driver runs these against the same
parquet tables (registered as views) and compares results. Fragments are
CTE bodies combined by :func:`with_ctes`.
"""

from __future__ import annotations

K = "cast(json_extract_string(props, '$.k') as int)"

RAW = f"""
select event_id as id,
  case when event_type in ('purchase','signup') then 'planned' else 'unplanned' end as event_type,
  case when event_id % 2500 = 6 then 'vip_movement' when event_id % 500 = 11 then 'protest' else event_type end as event_cause,
  case when user_id % 16 = 0 then null else concat('corridor_', cast(user_id % 16 as varchar)) end as corridor,
  case when k % 3 = 0 then 'Low' else 'High' end as priority,
  (k % 13 = 0 or event_id % 500 = 11) as requires_road_closure,
  case when event_id % 97 = 5 then null else ts end as start_datetime,
  case when event_id % 5 = 0 then ts + to_seconds(secs) end as closed_datetime,
  case when event_id % 5 = 1 then ts + to_seconds(secs) end as resolved_datetime,
  case when event_id % 40 = 2 then ts + to_seconds(secs) end as end_datetime,
  case when user_id % 7 = 0 then null else concat('zone_', cast(user_id % 7 as varchar)) end as zone,
  concat('station_', cast(user_id % 16 as varchar), '_', cast(event_id % 3 as varchar)) as police_station,
  case when k % 4 = 0 then concat('junction_', cast(k as varchar)) end as junction,
  case when k % 5 = 0 then null else concat('address line ', cast(k as varchar)) end as address,
  cast(12.6 as double) + cast(event_id % 801 as double) / cast(1000 as double) as latitude,
  cast(77.2 as double) + cast((event_id * 7) % 801 as double) / cast(1000 as double) as longitude
from (select *, {K} as k,
        cast(floor(value * 120) as bigint)
        - case when event_id % 101 = 0 then 100000 else 0 end
        + case when event_id % 89 = 1 then 3000000 else 0 end as secs
      from events)
"""

INCOMING = f"""
select event_id as incident_id, ts as planned_start,
  case when event_id % 400 = 4 then 'flash_mob' when event_id % 500 = 24 then 'protest'
       when event_id % 500 = 44 then 'vip_movement' else event_type end as event_cause,
  case when event_id % 60 = 4 then 'new_road' when user_id % 16 = 0 then null
       else concat('corridor_', cast(user_id % 16 as varchar)) end as corridor,
  case when k % 3 = 0 then null else (k % 7 = 0) end as requires_road_closure,
  case when event_id % 9 = 0 then concat('junction_', cast(k as varchar)) when event_id % 9 = 1 then 'Unknown' end as junction,
  case when event_id % 4 = 0 then repeat(concat('address line ', cast(k as varchar), ' '), 9) when event_id % 4 = 1 then '  ' end as address
from (select *, {K} as k from events)
"""

FEEDBACK = f"""
select event_id * 2 + d as log_seq, ts + to_seconds(86400 + 60 * d) as logged_at,
  ts as event_datetime, event_type as event_cause,
  case when user_id % 16 = 0 then 'Unknown' else concat('corridor_', cast(user_id % 16 as varchar)) end as corridor,
  case when event_id % 150 = 9 then 'not-a-number' else cast(cast(floor(value) as bigint) as varchar) end as actual_duration_minutes,
  case when k % 4 = 0 then 'yes' when k % 4 = 1 then 'False' when k % 4 = 2 then 'true' end as actual_requires_road_closure,
  case when k % 3 = 0 then 'Low' when k % 3 = 1 then 'High' end as priority,
  concat('officer_', cast(user_id as varchar)) as verified_by,
  case when k % 8 < 4 then 'verified' when k % 8 = 4 then 'Verified ' when k % 8 = 5 then 'disputed'
       when k % 8 = 6 then 'pending' end as verification_status
from (select *, {K} as k from events) cross join (select 0 as d union all select 1 as d)
where d = 0 or event_id % 200 = 9
"""

HOUR_BUCKET = ("case when {h} >= 0 and {h} < 6 then 'night' when {h} >= 6 and {h} < 12 then 'morning' "
               "when {h} >= 12 and {h} < 18 then 'afternoon' when {h} >= 18 and {h} < 24 then 'evening' "
               "else 'evening' end")

PARSED = """
select *, start_datetime + interval 330 minute as start_datetime_ist,
  coalesce(closed_datetime, resolved_datetime, end_datetime) as effective_end_datetime,
  (epoch_us(coalesce(closed_datetime, resolved_datetime, end_datetime)) - epoch_us(start_datetime))
    / 60000000.0::double as duration_minutes
from raw
"""

FLAGGED = """
select *, start_datetime is null as f_missing,
  coalesce(duration_minutes < 0, false) as f_negative,
  coalesce(event_type = 'unplanned' and duration_minutes > 1440, false) as f_unplanned,
  coalesce(event_type = 'planned' and duration_minutes > 43200, false) as f_planned
from parsed
"""

CLEAN = f"""
select id, event_type, event_cause,
  coalesce(nullif(corridor, 'NULL'), 'Non-corridor') as corridor, priority,
  coalesce(requires_road_closure, false) as requires_road_closure,
  start_datetime, end_datetime, closed_datetime, resolved_datetime,
  start_datetime_ist, effective_end_datetime, duration_minutes,
  duration_minutes is not null as has_duration,
  coalesce(nullif(zone, 'NULL'), 'Unknown') as zone, police_station,
  coalesce(nullif(junction, 'NULL'), 'Unknown') as junction, address, latitude, longitude,
  hour(start_datetime_ist) as hour_of_day, isodow(start_datetime_ist) - 1 as day_of_week,
  (isodow(start_datetime_ist) - 1) in (5, 6) as is_weekend,
  {HOUR_BUCKET.format(h='hour(start_datetime_ist)')} as hour_bucket
from flagged where not (f_missing or f_negative or f_unplanned or f_planned)
"""


def rnd(x: str, digits: int) -> str:
    """numpy-style rounding: half-even on x * 10**digits."""
    scale = f"{10 ** digits}.0::double"
    return f"(round_even(({x}) * {scale}, 0) / {scale} + 0.0::double)"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, slots: dict[str, str]) -> str:
    """SQL that replaces the {name} slots of a text expression, in the order given."""
    for name, value in slots.items():
        template = f"replace({template}, '{{{name}}}', cast({value} as varchar))"
    return template


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} as ({sql})" for name, sql in ctes)
    return f"with {body}\n{final}"


BASE_CTES = [("raw", RAW), ("parsed", PARSED), ("flagged", FLAGGED), ("clean", CLEAN)]


def grain_ctes(name: str, keys: list[str], src: str = "clean", cause_grain: bool = False) -> list[tuple[str, str]]:
    k = ", ".join(keys)
    notnull = " and ".join(f"{c} is not null" for c in keys)
    on = " and ".join(f"s.{c} = p.{c}" for c in keys)
    dur_count = "count(duration_minutes) filter (where has_duration)"
    dc = dur_count if cause_grain else f"case when {dur_count} > 0 then {dur_count} end"
    stats = f"""
select {k}, count(id) as event_count,
  {rnd(f"count(*) filter (where coalesce(requires_road_closure, false))::double / count(*)", 4)} as road_closure_rate,
  {dc} as duration_count,
  {rnd(f"sum(round(duration_minutes * 60000000.0::double)::bigint) filter (where has_duration)::double / {dur_count} / 60000000.0::double", 2)} as mean_duration_minutes,
  {rnd("(quantile_disc(duration_minutes, 0.5) filter (where has_duration) - quantile_disc(-duration_minutes, 0.5) filter (where has_duration)) / 2.0::double", 2)} as median_duration_minutes
from {src} where {notnull} group by {k}
"""
    modes = f"""
select {k}, priority, row_number() over (partition by {k} order by count(*) desc, priority) as rn
from {src} where {notnull} and priority is not null group by {k}, priority
"""
    final = f"""
select s.*, coalesce(p.priority, 'Unknown') as priority_mode
from {name}_s s left join {name}_p p on {on} and p.rn = 1
"""
    return [(f"{name}_s", stats), (f"{name}_p", modes), (name, final)]


FINE_KEYS = ["corridor", "event_cause", "is_weekend", "hour_bucket"]
COARSE_KEYS = ["event_cause", "is_weekend", "hour_bucket"]
CAUSE_KEYS = ["event_cause"]

BASELINE_SELECT = ("corridor, event_cause, is_weekend, hour_bucket, event_count, road_closure_rate, "
                   "priority_mode, duration_count, mean_duration_minutes, median_duration_minutes, match_level")


def baseline_ctes(src: str = "clean", prefix: str = "") -> list[tuple[str, str]]:
    p = prefix
    ctes = (grain_ctes(f"{p}fine_all", FINE_KEYS, src) + grain_ctes(f"{p}coarse_all", COARSE_KEYS, src)
            + grain_ctes(f"{p}cause_all", CAUSE_KEYS, src, cause_grain=True))
    ctes += [
        (f"{p}bl_fine", f"select *, 'fine' as match_level from {p}fine_all where duration_count >= 5"),
        (f"{p}bl_coarse", f"select cast(null as varchar) as corridor, *, 'coarse' as match_level from {p}coarse_all"),
        (f"{p}bl_table", f"select {BASELINE_SELECT} from {p}bl_fine union all select {BASELINE_SELECT} from {p}bl_coarse"),
    ]
    return ctes


FEATS = f"""
select *, coalesce(nullif(corridor, ''), 'Non-corridor') as match_corridor,
  hour(planned_start) as hour_of_day, isodow(planned_start) - 1 as day_of_week,
  (isodow(planned_start) - 1) in (5, 6) as is_weekend,
  {HOUR_BUCKET.format(h='hour(planned_start)')} as hour_bucket
from incoming
"""


def matched_sql(feats: str = "feats", prefix: str = "") -> str:
    p = prefix
    return f"""
select i.*,
  case when f.event_cause is not null then 'fine' when c.event_cause is not null then 'coarse'
       when k.event_cause is not null then 'cause_only' else 'no_data' end as match_level,
  case when f.event_cause is not null then f.median_duration_minutes when c.event_cause is not null
       then c.median_duration_minutes else k.median_duration_minutes end as median_duration_minutes,
  case when f.event_cause is not null then f.road_closure_rate when c.event_cause is not null
       then c.road_closure_rate else k.road_closure_rate end as road_closure_rate,
  coalesce(case when f.event_cause is not null then f.event_count when c.event_cause is not null
       then c.event_count else k.event_count end, 0) as evidence_count,
  coalesce(case when f.event_cause is not null then f.duration_count when c.event_cause is not null
       then c.duration_count else k.duration_count end, 0) as duration_count,
  coalesce(case when f.event_cause is not null then f.priority_mode when c.event_cause is not null
       then c.priority_mode else k.priority_mode end, 'Unknown') as priority_mode
from {feats} i
left join {p}bl_fine f on f.corridor = i.match_corridor and f.event_cause = i.event_cause
  and f.is_weekend = i.is_weekend and f.hour_bucket = i.hour_bucket
left join (select * from {p}coarse_all where duration_count >= 5) c on c.event_cause = i.event_cause
  and c.is_weekend = i.is_weekend and c.hour_bucket = i.hour_bucket
left join {p}cause_all k on k.event_cause = i.event_cause
"""


SEV_DUR = ("case when {m} is null then 'Unknown' when {m} < 50.0::double then 'Low' "
           "when {m} < 120.0::double then 'Medium' else 'High' end")
PSCORE = ("case when {p} = 'High' then 1.0::double when {p} = 'Low' then 0.2::double "
          "when {p} = 'Unknown' then 0.5::double else 0.5::double end")
SCORE = "({r} * 0.7::double + " + PSCORE + " * 0.3::double)"
SEV_SCORE = ("case when {s} < 0.35::double then 'Low' when {s} < 0.65::double then 'Medium' "
             "when {s} < 1.01::double then 'High' else 'Unknown' end")
BUMP = ("case when {flag} is not distinct from true and {ok} then "
        "case when {t} = 'Low' then 'Medium' when {t} = 'Medium' then 'High' else {t} end else {t} end")


def severity_sql(src: str) -> str:
    score = SCORE.format(r="road_closure_rate", p="priority_mode")
    base = (f"case when match_level = 'no_data' then 'Unknown' "
            f"when duration_count >= 5 and median_duration_minutes is not null then "
            f"{SEV_DUR.format(m='median_duration_minutes')} "
            f"when road_closure_rate is null then case when requires_road_closure is not distinct from true "
            f"then 'Medium' else 'Unknown' end else {SEV_SCORE.format(s=score)} end")
    ok = ("(match_level <> 'no_data' and ((duration_count >= 5 and median_duration_minutes is not null) "
          "or road_closure_rate is not null))")
    return f"""
select *,
  case when duration_count >= 5 then 'high' else 'low' end as duration_reliability,
  case when match_level = 'no_data' then 'unknown'
       when duration_count >= 5 and median_duration_minutes is not null then 'duration'
       else 'closure_priority' end as severity_basis,
  {BUMP.format(flag='requires_road_closure', ok=ok, t='(' + base + ')')} as severity_tier,
  case when match_level = 'no_data' then 'Insufficient data — defer to officer judgment'
       when match_level = 'cause_only' then 'Low confidence — cause-only match (' || evidence_count::varchar
         || ' historical events; duration reliability: '
         || case when duration_count >= 5 then 'high' else 'low' end || ')'
       when match_level in ('fine', 'coarse') then
         case when evidence_count >= 10 then 'High confidence' else 'Moderate confidence' end
       else 'Unknown confidence' end as confidence_label,
  median_duration_minutes as expected_duration_minutes,
  road_closure_rate as road_closure_probability
from {src}
"""


FORECAST_CTES = BASE_CTES + baseline_ctes() + [
    ("incoming", INCOMING), ("feats", FEATS), ("matched", matched_sql()),
    ("fc", severity_sql("matched")),
]

FORECAST_SELECT = ("incident_id, event_cause, match_corridor as corridor, requires_road_closure, "
                   "planned_start as start_local, hour_bucket, is_weekend, match_level, "
                   "expected_duration_minutes, road_closure_probability, severity_tier, evidence_count, "
                   "duration_count, duration_reliability, confidence_label, severity_basis, priority_mode")
