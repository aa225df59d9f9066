"""Registered queries: scans, cleaning, data quality (SC, CL, DQ)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from roadcast.functions import expressions as X
from roadcast.operators import cleaning
from roadcast.plans import context as ctx
from roadcast.plans import oracle as O
from roadcast.plans.registry import register

W = O.with_ctes
B = O.BASE_CTES


@register("scan_null_tokens", W(B[:1], """
select id, event_cause, corridor, zone, junction, address from raw"""))
def scan_null_tokens(spark, sf_dir):
    """SC1: null tokens normalised on every text column of the raw log."""
    return cleaning.null_tokens(ctx.raw(spark, sf_dir)).select(
        "id", "event_cause", "corridor", "zone", "junction", "address")


@register("parse_ts", W(B[:1], """
select id, start_datetime, end_datetime, closed_datetime, resolved_datetime from raw"""))
def parse_ts(spark, sf_dir):
    """CL1: the four timestamp columns as UTC instants."""
    return cleaning.with_parsed_times(ctx.raw(spark, sf_dir)).select(
        "id", "start_datetime", "end_datetime", "closed_datetime", "resolved_datetime")


@register("ist_time", W(B[:2], "select id, start_datetime_ist from parsed"))
def ist_time(spark, sf_dir):
    """CL2: start as IST wall clock."""
    return cleaning.with_parsed_times(ctx.raw(spark, sf_dir)).select("id", "start_datetime_ist")


@register("effective_end", W(B[:2], "select id, effective_end_datetime from parsed"))
def effective_end(spark, sf_dir):
    """CL3: closed -> resolved -> end."""
    return cleaning.with_parsed_times(ctx.raw(spark, sf_dir)).select("id", "effective_end_datetime")


@register("duration", W(B[:2], "select id, round(duration_minutes, 6) as duration_minutes from parsed"))
def duration(spark, sf_dir):
    """CL4: duration in minutes."""
    return cleaning.with_parsed_times(ctx.raw(spark, sf_dir)).select(
        "id", F.round("duration_minutes", 6).alias("duration_minutes"))


CLEAN_COLS = ("id, event_type, event_cause, corridor, priority, requires_road_closure, start_datetime, "
              "start_datetime_ist, effective_end_datetime, round(duration_minutes, 6) as duration_minutes, "
              "has_duration, zone, junction, hour_of_day, day_of_week, is_weekend, hour_bucket")


@register("clean_incidents", W(B, f"select {CLEAN_COLS} from clean"))
def clean_incidents(spark, sf_dir):
    """CL5/CL7-CL10: the cleaned incident table."""
    c = ctx.clean(spark, sf_dir)
    return c.select("id", "event_type", "event_cause", "corridor", "priority", "requires_road_closure",
                    "start_datetime", "start_datetime_ist", "effective_end_datetime",
                    F.round("duration_minutes", 6).alias("duration_minutes"), "has_duration", "zone",
                    "junction", "hour_of_day", "day_of_week", "is_weekend", "hour_bucket")


@register("dropped_rows", W(B[:3], """
select id, event_type, case
  when f_planned then 'Planned duration exceeds 30 days (' || printf('%.2f', duration_minutes) || ' mins)'
  when f_unplanned then 'Unplanned duration exceeds 24 hours (' || printf('%.2f', duration_minutes) || ' mins)'
  when f_negative then 'Negative duration (' || printf('%.2f', duration_minutes) || ' mins)'
  when f_missing then 'Missing start_datetime' end as reason
from flagged where f_missing or f_negative or f_unplanned or f_planned"""))
def dropped_rows(spark, sf_dir):
    """SC4/CL6: dropped rows with the reason of the last matching rule."""
    return cleaning.dropped_rows(ctx.raw(spark, sf_dir)).select("id", "event_type", "reason")


@register("fill_categoricals", W(B, "select id, corridor, zone, junction from clean"))
def fill_categoricals(spark, sf_dir):
    """CL8: corridor -> Non-corridor, zone/junction -> Unknown."""
    return ctx.clean(spark, sf_dir).select("id", "corridor", "zone", "junction")


@register("time_features", W(B, "select id, hour_of_day, day_of_week, is_weekend from clean"))
def time_features(spark, sf_dir):
    """CL9: hour, weekday (0 = Monday), weekend flag from IST."""
    return ctx.clean(spark, sf_dir).select("id", "hour_of_day", "day_of_week", "is_weekend")


@register("hour_bucket", W(B, "select id, hour_of_day, hour_bucket from clean"))
def hour_bucket(spark, sf_dir):
    """CL10: night / morning / afternoon / evening."""
    return ctx.clean(spark, sf_dir).select("id", "hour_of_day", "hour_bucket")


@register("geo_filter", W(B, """
select id, try_cast(latitude as double) as lat, try_cast(longitude as double) as lon from clean
where try_cast(latitude as double) between 12.7::double and 13.3::double
  and try_cast(longitude as double) between 77.3::double and 77.9::double"""))
def geo_filter(spark, sf_dir):
    """CL12: incidents inside the coordinate validity box."""
    return cleaning.geo_valid(ctx.clean(spark, sf_dir)).select("id", "lat", "lon")


@register("dq_summary", W(B[:3], """
select count(*) as rows_in,
  count(*) filter (where not (f_missing or f_negative or f_unplanned or f_planned)) as rows_kept,
  count(*) filter (where f_missing or f_negative or f_unplanned or f_planned) as rows_dropped,
  count(*) filter (where not (f_missing or f_negative or f_unplanned or f_planned) and duration_minutes is not null) as rows_with_duration,
  round(count(*) filter (where not (f_missing or f_negative or f_unplanned or f_planned)) * 100.0::double / count(*), 2) as kept_pct,
  round(count(*) filter (where f_missing or f_negative or f_unplanned or f_planned) * 100.0::double / count(*), 2) as dropped_pct
from flagged"""))
def dq_summary(spark, sf_dir):
    """DQ1: rows in / kept / dropped with percentages."""
    return cleaning.dq_summary(ctx.raw(spark, sf_dir))


@register("dq_drop_breakdown", W(B[:3], """
select 'missing_start' as rule, count(*) filter (where f_missing) as rows from flagged
union all select 'negative_duration', count(*) filter (where f_negative) from flagged
union all select 'unplanned_over_24h', count(*) filter (where f_unplanned) from flagged
union all select 'planned_over_30d', count(*) filter (where f_planned) from flagged"""))
def dq_drop_breakdown(spark, sf_dir):
    """DQ2: rows caught by each drop rule."""
    return cleaning.dq_drop_breakdown(ctx.raw(spark, sf_dir))


@register("dq_duration_by_type", W(B, """
select event_type, count(*) as rows, count(*) filter (where has_duration) as with_duration,
  count(*) filter (where not has_duration) as without_duration from clean group by event_type"""))
def dq_duration_by_type(spark, sf_dir):
    """DQ3: has-duration split by event type."""
    return cleaning.dq_duration_by_type(ctx.clean(spark, sf_dir))


def _null_profile_sql() -> str:
    parts = []
    for c in cleaning.DQ_KEY_COLUMNS:
        parts.append(f"select '{c}' as column_name, true as present, count(*) filter (where {c} is null) as null_count, "
                     f"round(count(*) filter (where {c} is null) * 100.0::double / count(*), 2) as null_pct from clean")
    return W(B, "\nunion all ".join(parts))


@register("dq_null_profile", _null_profile_sql())
def dq_null_profile(spark, sf_dir):
    """DQ4: null count and percent for the key columns."""
    return cleaning.dq_null_profile(ctx.clean(spark, sf_dir))


@register("kpi_event_split", W(B, """
select count(*) as total_events,
  count(*) filter (where event_type = 'planned') as planned_events,
  count(*) filter (where event_type = 'unplanned') as unplanned_events,
  round(count(*) filter (where event_type = 'planned') * 100.0::double / count(*), 1) as planned_pct,
  round(count(*) filter (where event_type = 'unplanned') * 100.0::double / count(*), 1) as unplanned_pct
from clean"""))
def kpi_event_split(spark, sf_dir):
    """DQ5: total, planned and unplanned counts and shares."""
    c = ctx.clean(spark, sf_dir)
    a = c.agg(F.count(F.lit(1)).alias("total_events"),
              F.count_if(F.col("event_type") == "planned").alias("planned_events"),
              F.count_if(F.col("event_type") == "unplanned").alias("unplanned_events"))
    return a.select("*",
                    F.round(F.col("planned_events") * 100.0 / F.col("total_events"), 1).alias("planned_pct"),
                    F.round(F.col("unplanned_events") * 100.0 / F.col("total_events"), 1).alias("unplanned_pct"))


@register("top_corridors", W(B, """
select corridor, count(*) as events from clean group by corridor
order by events desc, corridor limit 5"""))
def top_corridors(spark, sf_dir):
    """DQ6: five busiest corridors (TakeOrdered: partial top-k per task)."""
    c = ctx.clean(spark, sf_dir)
    return (c.groupBy("corridor").agg(F.count(F.lit(1)).alias("events"))
            .orderBy(F.desc("events"), F.asc("corridor")).limit(5))


@register("domain_values", W([*B, ("d", """
  select 'event_cause' as domain, event_cause as value, 0 as tier from (select distinct event_cause from clean where event_cause is not null)
  union all select 'corridor', corridor, 0 from (select distinct corridor from clean where corridor is not null and corridor <> 'Non-corridor')
  union all select 'corridor', 'Unknown', -1
  union all select 'priority', priority, case priority when 'High' then -3 when 'Low' then -2 else 0 end
    from (select distinct priority from clean where priority is not null and priority <> 'Unknown')
  union all select 'priority', 'Unknown', -1""")], """
select domain, (row_number() over (partition by domain order by tier, value))::int as position, value from d"""))
def domain_values(spark, sf_dir):
    """DQ7: causes, corridors (Unknown first, without Non-corridor) and priorities (High, Low, Unknown, others) as offered, in order."""
    return cleaning.domain_values(ctx.clean(spark, sf_dir))


@register("severity_proxy", W(B, f"""
select id, duration_minutes is not null as has_duration, {O.SEV_DUR.format(m='duration_minutes')} as severity_proxy
from clean"""))
def severity_proxy(spark, sf_dir):
    """FC8: historical severity proxy from the actual duration."""
    c = ctx.clean(spark, sf_dir)
    return c.select("id", F.col("duration_minutes").isNotNull().alias("has_duration"),
                    X.severity_proxy(F.col("duration_minutes")).alias("severity_proxy"))


# --- SC2, SC3: the cleaned log, stored by start date -----------------------------------------

STORED = """id, event_cause, corridor, priority, requires_road_closure, round(duration_minutes, 6) as duration_minutes, has_duration,
  hour_of_day, hour_bucket, start_date"""
DATED = [*B, ("dated", "select *, start_datetime_ist::date as start_date from clean"),
         ("busiest", "select start_date from dated where start_date is not null group by start_date order by count(*) desc, start_date limit 3")]


def stored_clean(spark, sf_dir):
    """Path of the cleaned log, written by start date."""
    from roadcast.sources import sinks
    from roadcast.streaming.replay import scratch
    path = scratch(spark, "clean-log")
    sinks.write_clean(ctx.clean(spark, sf_dir), path)
    return path


def _stored_columns(rows):
    return rows.select("id", "event_cause", "corridor", "priority", "requires_road_closure", F.round("duration_minutes", 6).alias("duration_minutes"),
                       "has_duration", "hour_of_day", "hour_bucket", "start_date")


@register("stored_date_range", W(DATED, f"""
select {STORED} from dated where start_date between (select min(start_date) + 3 from dated) and (select min(start_date) + 12 from dated)"""))
def stored_date_range(spark, sf_dir):
    """SC2/SC3: ten days, from the fourth on, of the stored log; the scan lists their folders only."""
    from roadcast.sources import sinks
    path = stored_clean(spark, sf_dir)
    start = spark.read.parquet(path).agg(F.min("start_date")).first()[0]
    if start is None:
        return _stored_columns(sinks.read_clean(spark, path).limit(0))
    day = lambda n: (start + datetime.timedelta(days=n)).isoformat()
    return _stored_columns(sinks.read_clean(spark, path, day(3), day(12)))


@register("stored_busiest_days", W(DATED, f"select {STORED} from dated where start_date in (select start_date from busiest)"))
def stored_busiest_days(spark, sf_dir):
    """SC2/SC3: incidents of the three busiest dates; the join prunes the folders at run time."""
    from roadcast.sources import sinks
    path = stored_clean(spark, sf_dir)
    days = spark.read.parquet(path).where("start_date IS NOT NULL").groupBy("start_date").agg(F.count(F.lit(1)).alias("n"))
    days = days.orderBy(F.desc("n"), "start_date").limit(3)
    return _stored_columns(sinks.read_clean(spark, path, dates=days))


# --- SC1: the log as CSV -------------------------------------------------------------------

#: Planted in the written log: null tokens, times that aren't any, lines that break off.
CSV_RAW = """
select * replace (
  case when id % 11 = 0 or corridor in ('NULL', 'null', '') then null else corridor end as corridor,
  case when id % 13 = 0 then null else zone end as zone, case when id % 17 = 0 then null else junction end as junction,
  case when id % 97 = 6 then null else start_datetime end as start_datetime)
from raw0 where id % 250 <> 3"""
CSV_CTES = [("raw0", B[0][1]), ("raw", CSV_RAW), *B[1:]]
CSV_COLUMNS = ["event_type", "event_cause", "corridor", "priority", "requires_road_closure", "start_datetime", "zone", "junction",
               "address", "has_duration", "hour_of_day", "day_of_week", "hour_bucket"]


def _written_csv(spark, sf_dir):
    """The raw incidents as a folder of CSV files, under other names and with planted faults."""
    from roadcast.sources import feedback_files as FF
    from roadcast.sources import incident_csv as IC
    from roadcast.streaming.replay import scratch
    raw = ctx.raw(spark, sf_dir)
    number = F.col("id").cast("long")
    planted = {"corridor": F.when(number % 11 == 0, F.lit("NULL")).otherwise(F.col("corridor")),
               "zone": F.when(number % 13 == 0, F.lit("null")).otherwise(F.col("zone")),
               "junction": F.when(number % 17 == 0, F.lit("")).otherwise(F.col("junction")),
               "start_datetime": F.when(number % 97 == 6, F.lit("yesterday, about ten")).otherwise(F.col("start_datetime").cast("string"))}
    names = {"id": "Event ID", "event_cause": "cause", "latitude": "lat", "longitude": "lon"}
    texts = raw.select(*(planted.get(c, F.col(c).cast("string")).alias(names.get(c, c)) for c in IC.COLUMNS))
    path = scratch(spark, "incident-csv")
    texts.where("cast(`Event ID` as long) % 250 <> 3").write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/whole")
    broken = raw.where(number % 250 == 3).select(F.col("id").cast("string").alias("id"), "event_type")
    FF.write_with_header(broken, f"{path}/broken", ",".join(texts.columns))
    return f"{path}/*"


@register("csv_clean", W(CSV_CTES, f"select id, round(duration_minutes, 6) as duration_minutes, {', '.join(CSV_COLUMNS)} from clean"))
def csv_clean(spark, sf_dir):
    """SC1/CL1/CL8: the log written as CSV with null tokens, bad times and broken lines, read back and cleaned."""
    from roadcast.sources import incident_csv as IC
    rows = cleaning.clean_incidents(IC.read_incidents(spark, _written_csv(spark, sf_dir)))
    return rows.select(F.col("id").cast("long").alias("id"), F.round("duration_minutes", 6).alias("duration_minutes"), *CSV_COLUMNS)


@register("csv_rejects", W(B[:1], "select id::varchar as id, id::varchar || ',' || event_type as line, 2 as fields from raw where id % 250 = 3"))
def csv_rejects(spark, sf_dir):
    """SC1: lines of that log which don't have the header's number of fields."""
    from roadcast.sources import incident_csv as IC
    return IC.read_rejects(spark, _written_csv(spark, sf_dir))
