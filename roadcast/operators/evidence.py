"""Evidence rows, brief records and map data (EV1-EV7).

Evidence is never a join of incidents x history: one cause can hold a third
of the history. Instead the history is reduced once to

* counts and newest time per cause and per (corridor, cause), and
* the newest K rows per cause and per (corridor, cause), ranked among the
  days that hold them: counts per day say which those are,

and the incoming incidents join those small tables (each written, and
broadcast or not by its bytes). Fine matches use the (corridor, cause) tables; every other tier
uses the cause tables. A brief's list is built once for each key that
incidents ask for, not once for each incident.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.functions import expressions as X
from roadcast.operators.sizing import broadcast_if_small, materialize

EVIDENCE_COLUMNS = ["start_datetime_ist", "event_cause", "corridor", "priority", "requires_road_closure",
                    "duration_minutes", "police_station", "junction"]


def evidence_counts(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and newest time per (corridor, cause), rolled up to cause: one scan."""
    h = history.where(F.col("event_cause").isNotNull())
    by_pair_all = h.groupBy("corridor", "event_cause").agg(
        F.count(F.lit(1)).alias("evidence_rows"), F.max("start_datetime_ist").alias("newest_evidence"))
    by_pair_all = materialize(by_pair_all)  # feeds both tables below
    by_cause = by_pair_all.groupBy("event_cause").agg(F.sum("evidence_rows").alias("evidence_rows"),
                                                      F.max("newest_evidence").alias("newest_evidence"))
    by_pair = by_pair_all.where(F.col("corridor").isNotNull())
    return by_cause, by_pair


def evidence_summary(fc: DataFrame, history: DataFrame) -> DataFrame:
    """EV1: evidence row count and newest evidence time per forecast."""
    by_cause, by_pair = evidence_counts(history)
    c = broadcast_if_small(by_cause.select(F.col("event_cause").alias("_e_cause"),
                                           F.col("evidence_rows").alias("_e_rows_c"),
                                           F.col("newest_evidence").alias("_e_new_c")))
    p = broadcast_if_small(by_pair.select(F.col("corridor").alias("_p_corr"), F.col("event_cause").alias("_p_cause"),
                                          F.col("evidence_rows").alias("_e_rows_p"),
                                          F.col("newest_evidence").alias("_e_new_p")))
    j = fc.join(c, fc["event_cause"] == c["_e_cause"], "left").join(
        p, (fc["corridor"] == p["_p_corr"]) & (fc["event_cause"] == p["_p_cause"]), "left")
    fine = F.col("match_level") == "fine"
    return j.select(*fc.columns,
                    F.coalesce(F.when(fine, F.col("_e_rows_p")).otherwise(F.col("_e_rows_c")), F.lit(0))
                    .alias("evidence_rows"),
                    F.when(fine, F.col("_e_new_p")).otherwise(F.col("_e_new_c")).alias("newest_evidence"))


def newest_k(history: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Newest ``k`` rows per key (ties by id), with ``evidence_rank``."""
    w = Window.partitionBy(*keys).orderBy(F.col("start_datetime_ist").desc(), F.col("id").asc())
    h = history.where(F.col("event_cause").isNotNull())
    for key in keys:
        h = h.where(F.col(key).isNotNull())
    rows = h.select("id", *EVIDENCE_COLUMNS).withColumn("_day", F.to_date("start_datetime_ist"))
    days = newest_days(rows, keys, k)
    on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(days[f"_d_{c}"]) for c in [*keys, "_day"]])
    return rows.join(days, on, "left_semi").drop("_day").withColumn("evidence_rank", F.row_number().over(w)) \
        .where(F.col("evidence_rank") <= k)


def newest_days(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(_d_<key>..., _d__day): the days of each key that its newest ``k`` rows are in, rows without a time last."""
    per = rows.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_day").desc()))
    held = per.withColumn("_newer", upto - F.col("_n")).where(F.col("_newer") < k)
    return broadcast_if_small(held.select(*(F.col(c).alias(f"_d_{c}") for c in [*keys, "_day"])))


ANY_CORRIDOR = "\u0000any"  # lookup key of cause-level rows (never a real corridor)


def _lookup_key() -> F.Column:
    return F.when(F.col("match_level") == "fine", F.col("corridor")).otherwise(F.lit(ANY_CORRIDOR))


def evidence_top_k(fc: DataFrame, history: DataFrame, k: int = C.EVIDENCE_TOP_K) -> DataFrame:
    """EV2: newest ``k`` evidence rows per forecast, by match level.

    The history is ranked once per (corridor, cause); a cause's newest ``k``
    rows are always among its corridors' newest ``k``, so the cause-level
    list is ranked from that small table. Both lists go into one lookup keyed
    by (corridor or a cause-level marker, cause): one broadcast equi-join.
    """
    pair = materialize(newest_k(history, ["corridor", "event_cause"], k))
    w = Window.partitionBy("event_cause").orderBy(F.col("start_datetime_ist").desc(), F.col("id").asc())
    cause = pair.drop("evidence_rank").withColumn("evidence_rank", F.row_number().over(w)) \
        .where(F.col("evidence_rank") <= k)
    by_pair = pair.withColumn("_kc", F.col("corridor"))
    by_cause = cause.withColumn("_kc", F.lit(ANY_CORRIDOR))
    lookup = broadcast_if_small(by_pair.unionByName(by_cause))
    inc = fc.select("incident_id", F.col("event_cause").alias("_cause"), "match_level", _lookup_key().alias("_key"))
    j = inc.join(lookup, (inc["_key"] == lookup["_kc"]) & (inc["_cause"] == lookup["event_cause"]))
    return j.drop("_cause", "_key", "_kc")


def brief_evidence(top: DataFrame, k: int = C.BRIEF_TOP_K) -> DataFrame:
    """EV3: top ``k`` rows per incident as an ordered ARRAY<STRUCT>, minutes as text."""
    rows = top.where(F.col("evidence_rank") <= k).select(
        "incident_id", "evidence_rank",
        F.struct(F.col("start_datetime_ist").cast("string").alias("start_datetime_ist"), "event_cause", "corridor",
                 "priority", "requires_road_closure",
                 F.when(F.col("duration_minutes").isNull(), F.lit(""))
                 .otherwise(X.whole(F.col("duration_minutes"))).alias("duration_minutes"),
                 "police_station", "junction").alias("row"))
    g = rows.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("evidence_rank", "row"))).alias("_r"))
    return g.select("incident_id", F.transform("_r", lambda x: x["row"]).alias("evidence"))


class BriefEvidence(NamedTuple):
    """asking: the forecasts and ``_asks``, what their list is kept under; lists: (incident_id, evidence), one row for each ``_asks``."""
    asking: DataFrame
    lists: DataFrame


def brief_lists(fc: DataFrame, history: DataFrame, k: int = C.BRIEF_TOP_K) -> BriefEvidence:
    """EV2 and EV3 for every key that forecasts ask for.

    Forecasts of one match key have the same evidence, so the operators run on distinct keys in place of incidents. Rows
    that share an incident id have one list, with the evidence of all of them: these ask by their id.
    """
    again = fc.groupBy("incident_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    again = broadcast_if_small(again.select(F.col("incident_id").alias("_again_id"), F.lit(True).alias("_again")))
    asking = fc.join(again, fc["incident_id"].eqNullSafe(again["_again_id"]), "left")
    key = F.when(F.col("_again").isNull(), _lookup_key())
    asking = asking.withColumn("_asks", F.struct(F.when(F.col("_again"), F.col("incident_id")).alias("id"), key.alias("key"),
                                                 F.when(F.col("_again").isNull(), F.col("event_cause")).alias("cause")))
    fine = F.col("match_level") == "fine"
    asked = asking.groupBy("_asks", "_again", "event_cause", F.when(fine, F.lit("fine")).otherwise("").alias("match_level"),
                           F.when(fine, F.col("corridor")).alias("corridor")).agg(F.count(F.lit(1)).alias("_n"))
    times = F.when(F.col("_again"), F.col("_n")).otherwise(F.lit(1)).cast("int")
    asked = asked.withColumn("_time", F.explode(F.array_repeat(F.lit(0), times)))
    top = evidence_top_k(asked.withColumn("incident_id", F.col("_asks")), history, k)
    return BriefEvidence(asking.drop("_again_id", "_again"), broadcast_if_small(brief_evidence(top, k)))


def incident_evidence(brief: BriefEvidence) -> DataFrame:
    """EV3: (incident_id, evidence), one row for each incident id with evidence."""
    asks = brief.lists.select(F.col("incident_id").alias("_of"), "evidence")
    once = brief.asking.where(F.col("_asks.key").isNotNull())
    once = once.join(asks, once["_asks"] == asks["_of"]).select("incident_id", "evidence")
    return once.unionByName(asks.where(F.col("_of.key").isNull()).select(F.col("_of.id").alias("incident_id"), "evidence"))


def with_evidence(brief: BriefEvidence) -> DataFrame:
    """The forecasts with ``evidence``, null where there is none or the incident has no id."""
    asks = brief.lists.select(F.col("incident_id").alias("_of"), "evidence")
    rows = brief.asking
    return rows.join(asks, (rows["_asks"] == asks["_of"]) & rows["incident_id"].isNotNull(), "left").drop("_asks", "_of")


def fmt_minutes(c) -> F.Column:
    return F.when(c.isNull(), F.lit("Unknown")).otherwise(F.concat(X.whole(c), F.lit(" minutes")))


def fmt_percent(c) -> F.Column:
    return F.when(c.isNull(), F.lit("Unknown")).otherwise(
        F.concat(F.format_string("%.1f", F.bround(c * 100, 1)), F.lit("%")))


def brief_records(adv: DataFrame) -> DataFrame:
    """EV4: one nested printable-brief record per incident (advisories of :func:`with_evidence`)."""
    return adv.select(
        "incident_id",
        X.incident_code(F.col("event_cause"), F.col("planned_start")).alias("incident_code"),
        F.struct(X.title_words(F.col("event_cause")).alias("cause"),
                 F.coalesce(F.col("corridor_input"), F.lit("Non-corridor")).alias("location"),
                 F.col("planned_start").alias("planned_start")).alias("incident"),
        F.struct("severity_tier", fmt_minutes(F.col("expected_duration_minutes")).alias("expected_duration"),
                 fmt_percent(F.col("road_closure_probability")).alias("closure_probability"),
                 "evidence_count", "duration_count", "match_level", "confidence_label").alias("forecast"),
        F.struct("recommended_personnel_count", "barricade_recommended", "barricade_location_hint",
                 "diversion_suggestion").alias("deployment"),
        "vms_message", "advisory_text",
        F.coalesce(F.col("evidence"), F.array()).alias("evidence"),
    )


# --- map data ---------------------------------------------------------------------

def evidence_centre(valid: DataFrame) -> DataFrame:
    """EV5: mean position of valid points."""
    return valid.agg(X.np_round(F.avg("lat"), 6).alias("centre_lat"),
                     X.np_round(F.avg("lon"), 6).alias("centre_lon"),
                     F.count(F.lit(1)).alias("points"))


def density_grid(valid: DataFrame, cell: float = 0.01) -> DataFrame:
    """EV6: point density on a regular grid (partial aggregation per task)."""
    return valid.groupBy(F.floor(F.col("lat") / F.lit(cell)).alias("cell_lat"),
                         F.floor(F.col("lon") / F.lit(cell)).alias("cell_lon")).agg(
        F.count(F.lit(1)).alias("points"))


def marker_points(valid: DataFrame, cap: int = C.MARKER_CAP) -> DataFrame:
    """EV7: newest ``cap`` points with the severity-proxy class (TakeOrdered)."""
    return valid.orderBy(F.col("start_datetime_ist").desc(), F.col("id").asc()).limit(cap).select(
        "id", "lat", "lon", "start_datetime_ist", X.severity_proxy(F.col("duration_minutes")).alias("severity_proxy"))
