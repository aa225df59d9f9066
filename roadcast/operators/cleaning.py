"""Raw incident log -> cleaned incidents, dropped-row log, data-quality tables.

Cleaning is a single narrow stage (scan -> project -> filter): no shuffle.
The drop rules and their reason text are evaluated once into columns so the
kept and dropped outputs are two filters over the same projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.functions import expressions as X

TS_COLUMNS = ["start_datetime", "end_datetime", "closed_datetime", "resolved_datetime"]

DQ_KEY_COLUMNS = C.DQ_KEY_COLUMNS


def null_tokens(raw: DataFrame) -> DataFrame:
    """SC1: text tokens NULL / null / '' -> null on every string column."""
    cols = []
    for f in raw.schema.fields:
        if f.dataType.simpleString() == "string":
            cols.append(X.null_if_token(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return raw.select(*cols)


def _time_columns(raw: DataFrame) -> dict[str, Column]:
    """CL1-CL4 as composed expressions (no intermediate DataFrames)."""
    types = {f.name: f.dataType.simpleString() for f in raw.schema.fields}
    ts = {c: X.parse_timestamp(F.col(c), types[c]) for c in TS_COLUMNS if c in types}
    eff = F.coalesce(ts["closed_datetime"], ts["resolved_datetime"], ts["end_datetime"])
    return {**ts, "start_datetime_ist": X.to_local_wallclock(ts["start_datetime"]),
            "effective_end_datetime": eff,
            "duration_minutes": X.minutes_between(ts["start_datetime"], eff)}


def with_parsed_times(raw: DataFrame) -> DataFrame:
    """CL1-CL4: parse timestamps, IST wall clock, effective end, duration."""
    cols = _time_columns(raw)
    return raw.select(*[F.col(c) for c in raw.columns if c not in cols],
                      *[e.alias(n) for n, e in cols.items()])


def _drop_flags(d: Column, event_type: Column, start: Column) -> dict[str, Column]:
    return {
        "_missing_start": start.isNull(),
        "_negative": F.coalesce(d < 0, F.lit(False)),
        "_unplanned_cap": F.coalesce((event_type == "unplanned") & (d > C.UNPLANNED_MAX_MINUTES), F.lit(False)),
        "_planned_cap": F.coalesce((event_type == "planned") & (d > C.PLANNED_MAX_MINUTES), F.lit(False)),
    }


FLAGS = ["_missing_start", "_negative", "_unplanned_cap", "_planned_cap"]


def flagged(raw: DataFrame) -> DataFrame:
    """Parsed rows with the four drop flags and a combined ``_drop`` (one projection)."""
    cols = _time_columns(raw)
    flags = _drop_flags(cols["duration_minutes"], F.col("event_type"), cols["start_datetime"])
    drop = flags["_missing_start"] | flags["_negative"] | flags["_unplanned_cap"] | flags["_planned_cap"]
    return raw.select(*[F.col(c) for c in raw.columns if c not in cols],
                      *[e.alias(n) for n, e in cols.items()],
                      *[e.alias(n) for n, e in flags.items()], drop.alias("_drop"))


def _reason() -> Column:
    """CL6: the last matching rule wins, value with two decimals."""
    d2 = F.format_string("%.2f", F.col("duration_minutes"))
    return (F.when(F.col("_planned_cap"), F.concat(F.lit("Planned duration exceeds 30 days ("), d2, F.lit(" mins)")))
            .when(F.col("_unplanned_cap"), F.concat(F.lit("Unplanned duration exceeds 24 hours ("), d2, F.lit(" mins)")))
            .when(F.col("_negative"), F.concat(F.lit("Negative duration ("), d2, F.lit(" mins)")))
            .when(F.col("_missing_start"), F.lit("Missing start_datetime")))


def clean_incidents(raw: DataFrame) -> DataFrame:
    """CL1-CL10: the cleaned (silver) incident table: one filter, one projection."""
    df = flagged(raw).where(~F.col("_drop"))
    ist = F.col("start_datetime_ist")
    hour, dow = F.hour(ist), X.weekday_mon0(ist)
    closure = (F.coalesce(F.col("requires_road_closure").cast("boolean"), F.lit(False))
               if dict(raw.dtypes).get("requires_road_closure") == "boolean"
               else X.truthy_text(F.col("requires_road_closure")))
    derived = {
        "corridor": F.coalesce(X.null_if_token(F.col("corridor")), F.lit("Non-corridor")),
        "zone": F.coalesce(X.null_if_token(F.col("zone")), F.lit("Unknown")),
        "junction": F.coalesce(X.null_if_token(F.col("junction")), F.lit("Unknown")),
        "requires_road_closure": closure,
        "has_duration": F.col("duration_minutes").isNotNull(),
        "hour_of_day": hour,
        "day_of_week": dow,
        "is_weekend": X.is_weekend(dow),
        "hour_bucket": X.hour_bucket(hour),
    }
    keep = [c for c in df.columns if c not in FLAGS and c != "_drop" and c not in derived]
    return df.select(*keep, *[e.alias(n) for n, e in derived.items()])


def dropped_rows(raw: DataFrame) -> DataFrame:
    """SC4/CL6: dropped rows with their reason."""
    df = flagged(raw).where(F.col("_drop"))
    return df.select(*[c for c in df.columns if c not in FLAGS and c != "_drop"], _reason().alias("reason"))


def geo_valid(df: DataFrame) -> DataFrame:
    """CL12: points inside the validity box; text coordinates are cast safely."""
    lat = F.col("latitude").try_cast("double")
    lon = F.col("longitude").try_cast("double")
    return (df.withColumns({"lat": lat, "lon": lon})
            .where(lat.between(*C.GEO_LAT_RANGE) & lon.between(*C.GEO_LON_RANGE)))


# --- data quality (DQ1-DQ4) ------------------------------------------------

def dq_summary(raw: DataFrame) -> DataFrame:
    """DQ1: rows in / kept / dropped and percentages, one aggregate pass."""
    f = flagged(raw)
    agg = f.agg(F.count(F.lit(1)).alias("rows_in"),
                F.count_if(~F.col("_drop")).alias("rows_kept"),
                F.count_if(F.col("_drop")).alias("rows_dropped"),
                F.count_if(~F.col("_drop") & F.col("duration_minutes").isNotNull()).alias("rows_with_duration"))
    return agg.select(
        "rows_in", "rows_kept", "rows_dropped", "rows_with_duration",
        F.round(F.col("rows_kept") * 100.0 / F.col("rows_in"), 2).alias("kept_pct"),
        F.round(F.col("rows_dropped") * 100.0 / F.col("rows_in"), 2).alias("dropped_pct"))


def dq_drop_breakdown(raw: DataFrame) -> DataFrame:
    """DQ2: rows caught by each rule (rules may overlap)."""
    f = flagged(raw)
    agg = f.agg(F.count_if("_missing_start").alias("missing_start"),
                F.count_if("_negative").alias("negative_duration"),
                F.count_if("_unplanned_cap").alias("unplanned_over_24h"),
                F.count_if("_planned_cap").alias("planned_over_30d"))
    return agg.select(F.expr("stack(4, 'missing_start', missing_start, 'negative_duration', negative_duration, "
                             "'unplanned_over_24h', unplanned_over_24h, 'planned_over_30d', planned_over_30d) "
                             "as (rule, rows)"))


def dq_duration_by_type(clean: DataFrame) -> DataFrame:
    """DQ3: has-duration split by event type."""
    return clean.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("has_duration").alias("with_duration"),
        F.count_if(~F.col("has_duration")).alias("without_duration"))


def dq_null_profile(clean: DataFrame, columns=None) -> DataFrame:
    """DQ4: null count and percent per key column; absent columns reported."""
    columns = columns or DQ_KEY_COLUMNS
    present = set(clean.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        if c in present:
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"n_{c}"))
    a = clean.agg(*aggs)
    parts = []
    for c in columns:
        if c in present:
            parts.append(f"'{c}', true, n_{c}")
        else:
            parts.append(f"'{c}', false, cast(null as bigint)")
    stacked = a.select("_n", F.expr(f"stack({len(columns)}, {', '.join(parts)}) as (column_name, present, null_count)"))
    return stacked.select("column_name", "present", "null_count",
                          F.round(F.col("null_count") * 100.0 / F.col("_n"), 2).alias("null_pct"))


def domain_values(clean: DataFrame) -> DataFrame:
    """DQ7: (domain, position, value), the values offered for cause, corridor and priority, from one scan.

    Unknown is offered for corridor and priority whether or not it occurs. The order is that of the values, after High,
    Low and Unknown as far as they are there.
    """
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("domain"), F.col(c).alias("value")) for c in ("event_cause", "corridor", "priority"))))
    met = clean.select(named.alias("v")).select("v.*").where("value IS NOT NULL AND NOT (domain = 'corridor' AND value = 'Non-corridor')").distinct()
    offered = clean.sparkSession.createDataFrame([("corridor", "Unknown"), ("priority", "Unknown")], "domain string, value string")
    values = met.where("NOT (domain <> 'event_cause' AND value = 'Unknown')").unionByName(offered)
    tier = (F.when((F.col("domain") == "priority") & (F.col("value") == "High"), -3).when((F.col("domain") == "priority") & (F.col("value") == "Low"), -2)
            .when((F.col("domain") != "event_cause") & (F.col("value") == "Unknown"), -1).otherwise(0))
    w = Window.partitionBy("domain").orderBy(tier, "value")  # distinct values only
    return values.select("domain", F.row_number().over(w).alias("position"), "value")
