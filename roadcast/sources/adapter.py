"""Map the driver's generic ``events`` table onto the engine's inputs.

The driver data set carries no incident log, so three inputs are derived from
``events`` by fixed rules: the raw incident log, a table of incoming
(forecast-request) incidents and a verified-outcome feedback log. The same
rules are written as DuckDB SQL in :mod:`roadcast.plans.oracle` so both
engines start from identical rows.

All derivations are narrow projections of one scan: no shuffle, and the
scan reads only ``event_id, ts, user_id, event_type, value, props``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcast.sources.tables import read_table


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _plus_seconds(ts: Column, secs: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def _corridor_of(user_id: Column) -> Column:
    return F.when(user_id % 16 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("corridor_"), (user_id % 16).cast("string")))


def raw_incidents_from_events(events: DataFrame) -> DataFrame:
    """Bronze incident log: one row per event, timestamps as UTC instants."""
    e = events.select(
        "event_id", "user_id", "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
        _k().alias("k"),
        (F.floor(F.col("value") * 120).cast("bigint")
         - F.when(F.col("event_id") % 101 == 0, F.lit(100000)).otherwise(F.lit(0))
         + F.when(F.col("event_id") % 89 == 1, F.lit(3000000)).otherwise(F.lit(0))).alias("secs"),
    )
    eid, uid, k, ts, secs = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("ts"), F.col("secs")
    end_ts = _plus_seconds(ts, secs)
    null_ts = F.lit(None).cast("timestamp")
    return e.select(
        eid.alias("id"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit("planned"))
         .otherwise(F.lit("unplanned")).alias("event_type"),
        F.when(eid % 2500 == 6, F.lit("vip_movement"))
         .when(eid % 500 == 11, F.lit("protest"))
         .otherwise(F.col("event_type")).alias("event_cause"),
        _corridor_of(uid).alias("corridor"),
        F.when(k % 3 == 0, F.lit("Low")).otherwise(F.lit("High")).alias("priority"),
        ((k % 13 == 0) | (eid % 500 == 11)).alias("requires_road_closure"),
        F.when(eid % 97 == 5, null_ts).otherwise(ts).alias("start_datetime"),
        F.when(eid % 5 == 0, end_ts).alias("closed_datetime"),
        F.when(eid % 5 == 1, end_ts).alias("resolved_datetime"),
        F.when(eid % 40 == 2, end_ts).alias("end_datetime"),
        F.when(uid % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("zone_"), (uid % 7).cast("string"))).alias("zone"),
        F.concat(F.lit("station_"), (uid % 16).cast("string"), F.lit("_"),
                 (eid % 3).cast("string")).alias("police_station"),
        F.when(k % 4 == 0, F.concat(F.lit("junction_"), k.cast("string"))).alias("junction"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("address line "), k.cast("string"))).alias("address"),
        (F.lit(12.6) + (eid % 801).cast("double") / F.lit(1000.0)).alias("latitude"),
        (F.lit(77.2) + ((eid * 7) % 801).cast("double") / F.lit(1000.0)).alias("longitude"),
    )


def incoming_from_events(events: DataFrame) -> DataFrame:
    """Forecast requests: every event; ``planned_start`` is IST wall clock."""
    e = events.select("event_id", "user_id", "event_type", "ts", _k().alias("k"))
    eid, uid, k = F.col("event_id"), F.col("user_id"), F.col("k")
    return e.select(
        eid.alias("incident_id"),
        F.col("ts").cast("timestamp_ntz").alias("planned_start"),
        F.when(eid % 400 == 4, F.lit("flash_mob"))
         .when(eid % 500 == 24, F.lit("protest"))
         .when(eid % 500 == 44, F.lit("vip_movement"))
         .otherwise(F.col("event_type")).alias("event_cause"),
        F.when(eid % 60 == 4, F.lit("new_road")).otherwise(_corridor_of(uid)).alias("corridor"),
        F.when(k % 3 == 0, F.lit(None).cast("boolean")).otherwise(k % 7 == 0)
         .alias("requires_road_closure"),
        F.when(eid % 9 == 0, F.concat(F.lit("junction_"), k.cast("string"))).when(eid % 9 == 1, F.lit("Unknown"))
         .alias("junction"),
        F.when(eid % 4 == 0, F.repeat(F.concat(F.lit("address line "), k.cast("string"), F.lit(" ")), F.lit(9)))
         .when(eid % 4 == 1, F.lit("  ")).alias("address"),
    )


def feedback_log_from_events(events: DataFrame) -> DataFrame:
    """Feedback log with duplicates, bad numbers, blank priorities, mixed status."""
    e = events.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"), _k().alias("k"))
    # d = 1 duplicates every 200th event once (a resubmission one minute later).
    e = e.withColumn("d", F.explode(F.when(F.col("event_id") % 200 == 9, F.array(F.lit(0), F.lit(1)))
                                    .otherwise(F.array(F.lit(0)))))
    eid, uid, k, d = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("d")
    return e.select(
        (eid * 2 + d).alias("log_seq"),
        _plus_seconds(F.col("ts"), F.lit(86400) + F.lit(60) * d).alias("logged_at"),
        F.col("ts").alias("event_datetime"),
        F.col("event_type").alias("event_cause"),
        F.when(uid % 16 == 0, F.lit("Unknown"))
         .otherwise(F.concat(F.lit("corridor_"), (uid % 16).cast("string"))).alias("corridor"),
        F.when(eid % 150 == 9, F.lit("not-a-number"))
         .otherwise(F.floor("value").cast("bigint").cast("string")).alias("actual_duration_minutes"),
        F.when(k % 4 == 0, F.lit("yes")).when(k % 4 == 1, F.lit("False"))
         .when(k % 4 == 2, F.lit("true")).alias("actual_requires_road_closure"),
        F.when(k % 3 == 0, F.lit("Low")).when(k % 3 == 1, F.lit("High")).alias("priority"),
        F.concat(F.lit("officer_"), uid.cast("string")).alias("verified_by"),
        F.when(k % 8 < 4, F.lit("verified")).when(k % 8 == 4, F.lit("Verified "))
         .when(k % 8 == 5, F.lit("disputed")).when(k % 8 == 6, F.lit("pending"))
         .alias("verification_status"),
    )


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_incidents_from_events(read_table(spark, sf_dir, "events"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incoming_from_events(read_table(spark, sf_dir, "events"))


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_log_from_events(read_table(spark, sf_dir, "events"))
