"""Historical baselines: fine, coarse and cause grain in two passes over the history.

1. Minute histogram: one scan counts rows per (finest keys, whole minute of the duration, priority, closure), with the
   exact sum of durations. It has as many rows as there are such combinations, whatever the length of the history, and
   merges by addition: coarse and cause grains are sums of it, as are counts, rates, means and priority modes. Running
   counts over a group's minutes give the (at most two) minutes that hold its median.
2. Targeted scan: rows whose minute is a target of their fine, coarse or cause group are kept and counted by value; the
   middle values are interpolated like ``percentile(0.5)``: ``lo + (hi - lo) * 0.5``.

The source is either cleaned incidents or counted values (:func:`value_counts`), which carry a weight; counted values
add up, so a refresh needs no history (:func:`roadcast.operators.feedback.refresh_baseline`).

Semantics kept from the reference:
* null grouping keys never form a group (incidents without a cause are out);
* count / rate / mode use all rows, duration statistics only rows with a
  duration (aggregates skip nulls, so one aggregate serves both);
* priority mode = most frequent, smallest on ties, nulls ignored, 'Unknown'
  when empty;
* fine rows need duration_count >= 5; coarse rows are all kept (the match
  applies the threshold); duration_count is null when a fine/coarse group
  has no durations, 0 for the cause grain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.functions.expressions import np_round
from roadcast.operators.sizing import materialize

KEYS = ["corridor", "event_cause", "is_weekend", "hour_bucket"]
KEY_TYPES = {"corridor": "string", "event_cause": "string", "is_weekend": "boolean",
             "hour_bucket": "string"}
GRAINS = {
    "fine": ["corridor", "event_cause", "is_weekend", "hour_bucket"],
    "coarse": ["event_cause", "is_weekend", "hour_bucket"],
    "cause": ["event_cause"],
}
BASELINE_COLUMNS = ["corridor", "event_cause", "is_weekend", "hour_bucket", "event_count",
                    "road_closure_rate", "priority_mode", "duration_count",
                    "mean_duration_minutes", "median_duration_minutes", "match_level"]


SOURCE = [*KEYS, "_dur", "priority", "_closure", "_c", "_c_id"]
#: Microseconds of a minute: durations are summed as whole microseconds, so a sum doesn't depend on the order of tasks.
_MINUTE = 60_000_000


def counted_rows(clean: DataFrame) -> DataFrame:
    """SOURCE columns of cleaned incidents: each row counts one."""
    return clean.where(F.col("event_cause").isNotNull()).select(
        *KEYS, F.when(F.col("has_duration"), F.col("duration_minutes")).cast("double").alias("_dur"), "priority",
        F.coalesce(F.col("requires_road_closure"), F.lit(False)).alias("_closure"),
        F.lit(1).cast("long").alias("_c"), F.col("id").isNotNull().cast("long").alias("_c_id"))


def value_counts(clean: DataFrame) -> DataFrame:
    """SOURCE columns, one row for each distinct value of a finest group: the state that refreshes add to."""
    return add_counts(counted_rows(clean))


def add_counts(*sources: DataFrame) -> DataFrame:
    """The sum of counted sources."""
    rows = reduce(DataFrame.unionByName, [s.select(*SOURCE) for s in sources])
    return rows.groupBy(*SOURCE[:-2]).agg(F.sum("_c").alias("_c"), F.sum("_c_id").alias("_c_id"))


def minute_histogram(source: DataFrame) -> DataFrame:
    """(KEYS, _m, priority, _closure, _c, _c_id, _us): pass 1, a plain aggregate of one scan."""
    # microseconds past the whole minute: a long holds the sum of some 1.5e11 rows of one minute
    micros = (F.round(F.col("_dur") * F.lit(float(_MINUTE))).cast("long") - F.floor("_dur") * F.lit(_MINUTE)) * F.col("_c")
    return source.groupBy(*KEYS, F.floor("_dur").alias("_m"), "priority", "_closure").agg(
        F.sum("_c").alias("_c"), F.sum("_c_id").alias("_c_id"), F.sum(micros).alias("_us"))


def _groups(hist: DataFrame, grain: str) -> DataFrame:
    """``hist`` summed to a grain; keys that the grain leaves out are null, null keys form no group."""
    own = GRAINS[grain]
    rows = hist.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in own]))
    whole = F.col("_m").cast("decimal(18,0)") * F.lit(_MINUTE) * F.col("_c").cast("decimal(18,0)")
    rows = rows.withColumn("_us", (F.col("_us") + whole).cast("decimal(38,0)"))
    if own != KEYS:  # the histogram is of the finest grain
        rows = rows.groupBy(*own, "_m", "priority", "_closure").agg(*(F.sum(c).alias(c) for c in ("_c", "_c_id")), F.sum("_us").cast("decimal(38,0)").alias("_us"))
    return rows.select(F.lit(grain).alias("grain"), *(F.col(k) if k in own else F.lit(None).cast(KEY_TYPES[k]).alias(k) for k in KEYS),
                       "_m", "priority", "_closure", "_c", "_c_id", "_us")


def _targets(minutes: DataFrame) -> DataFrame:
    """(grain, KEYS, _m, _lo, _r1, _r2): minutes that hold a middle position; _lo rows of the group come before them."""
    group = Window.partitionBy("grain", *KEYS)
    run = group.orderBy("_m")
    per = minutes.where(F.col("_m").isNotNull()).groupBy("grain", *KEYS, "_m").agg(F.sum("_c").alias("_b"))
    per = per.withColumns({"_n": F.sum("_b").over(group), "_hi": F.sum("_b").over(run)})
    per = per.withColumns({"_lo": F.col("_hi") - F.col("_b"), "_r1": F.floor((F.col("_n") - 1) / 2), "_r2": F.floor(F.col("_n") / 2)})
    holds = lambda r: (F.col(r) >= F.col("_lo")) & (F.col(r) < F.col("_hi"))
    return per.where(holds("_r1") | holds("_r2")).select("grain", *KEYS, "_m", "_lo", "_r1", "_r2")


def target_values(source: DataFrame, targets: DataFrame, grains: tuple) -> DataFrame:
    """(grain, KEYS, _m, _v, _n): pass 2, counts of the values in target minutes; one scan, each side joined by its own bytes."""
    rows = source.where(F.col("_dur").isNotNull()).select(*KEYS, F.floor("_dur").alias("_m"), F.col("_dur").alias("_v"), "_c")
    for g in grains:
        side = targets.where(F.col("grain") == g).select(*(F.col(k).alias(f"_t_{k}") for k in GRAINS[g]), F.col("_m").alias("_t_m"), F.lit(True).alias(f"_is_{g}"))
        on = reduce(lambda a, b: a & b, [rows[k] == side[f"_t_{k}"] for k in GRAINS[g]]) & (rows["_m"] == side["_t_m"])
        rows = rows.join(side, on, "left").drop("_t_m", *(f"_t_{k}" for k in GRAINS[g]))
    rows = rows.where(reduce(lambda a, b: a | b, [F.col(f"_is_{g}").isNotNull() for g in grains]))
    named = [F.when(F.col(f"_is_{g}"), F.struct(F.lit(g).alias("grain"), *(
        F.col(k) if k in GRAINS[g] else F.lit(None).cast(KEY_TYPES[k]).alias(k) for k in KEYS))) for g in grains]
    kept = rows.select(F.explode(F.array_compact(F.array(*named))).alias("_g"), "_m", "_v", "_c").select("_g.*", "_m", "_v", "_c")
    return kept.groupBy("grain", *KEYS, "_m", "_v").agg(F.sum("_c").alias("_n"))


def _medians(values: DataFrame, targets: DataFrame) -> DataFrame:
    keys = ["grain", *KEYS]
    t = targets.select(*(F.col(k).alias(f"_t_{k}") for k in keys), F.col("_m").alias("_t_m"), "_lo", "_r1", "_r2")
    on = reduce(lambda a, b: a & b, [values[k].eqNullSafe(t[f"_t_{k}"]) for k in keys]) & (values["_m"] == t["_t_m"])
    rows = values.join(t, on).drop("_t_m", *(f"_t_{k}" for k in keys))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_m").orderBy("_v"))
    rows = rows.withColumn("_to", F.col("_lo") + upto).withColumn("_from", F.col("_to") - F.col("_n"))
    at = lambda r: F.max(F.when((F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_to")), F.col("_v")))
    return rows.groupBy(*keys).agg(at("_r1").alias("_m1"), at("_r2").alias("_m2")).select(
        *(F.col(k).alias(f"_d_{k}") for k in keys), ((F.col("_m1") + F.col("_m2")) / F.lit(2.0)).alias("_median"))


def grains_of(source: DataFrame, grains: tuple = ("fine", "coarse", "cause"), only: DataFrame | None = None) -> DataFrame:
    """Statistics of every group of ``grains`` (SOURCE columns in); ``only``: those groups (grain, KEYS)."""
    keys = ["grain", *KEYS]
    hist = materialize(minute_histogram(source), "minutes")
    minutes = reduce(DataFrame.unionByName, [_groups(hist, g) for g in grains])
    if only is not None:
        minutes = minutes.join(only, [minutes[k].eqNullSafe(only[k]) for k in keys], "left_semi")
    targets = materialize(_targets(minutes), "target-minutes")
    med = _medians(target_values(source, targets, grains), targets)
    c = F.col("_c")
    # Counts per (group, priority) carry every additive statistic, so one further aggregate yields both the statistics
    # and the priority mode (most frequent, smallest on ties; null priorities never win).
    pc = minutes.groupBy(*keys, "priority").agg(
        F.sum("_c_id").alias("_pid"), F.sum(c).alias("_pn"), F.sum(F.when(F.col("_closure"), c).otherwise(F.lit(0))).alias("_pcl"),
        F.sum(F.when(F.col("_m").isNotNull(), c).otherwise(F.lit(0))).alias("_pdn"), F.sum("_us").alias("_pus"))
    order = F.when(F.col("priority").isNotNull(), F.struct((-F.col("_pn")).alias("n"), F.col("priority").alias("p")))
    stats = pc.groupBy(*keys).agg(
        F.sum("_pid").alias("event_count"), F.sum("_pn").alias("_rows"), F.sum("_pcl").alias("_closed"),
        F.sum("_pdn").alias("_dur_n"), F.sum("_pus").alias("_dur_us"), F.min_by("priority", order).alias("_mode"))
    joined = stats.join(med, [stats[k].eqNullSafe(med[f"_d_{k}"]) for k in keys], "left")
    return joined.select(
        *[stats[k] for k in keys], F.col("event_count").cast("bigint").alias("event_count"),
        np_round(F.col("_closed").cast("double") / F.col("_rows"), 4).alias("road_closure_rate"),
        F.coalesce(F.col("_mode"), F.lit("Unknown")).alias("priority_mode"),
        F.when(stats["grain"] == "cause", F.col("_dur_n")).otherwise(F.when(F.col("_dur_n") > 0, F.col("_dur_n"))).cast("bigint").alias("duration_count"),
        np_round(F.col("_dur_us").cast("double") / F.col("_dur_n") / F.lit(float(_MINUTE)), 2).alias("mean_duration_minutes"),
        np_round(F.col("_median"), 2).alias("median_duration_minutes"))


def all_grains(clean: DataFrame, grains: tuple = ("fine", "coarse", "cause")) -> DataFrame:
    """Every group of every grain of cleaned incidents (fine rows not yet thresholded)."""
    return grains_of(counted_rows(clean), grains)


def touched_groups(source: DataFrame, grains: tuple = ("fine", "coarse", "cause")) -> DataFrame:
    """(grain, KEYS): the groups that rows of ``source`` belong to."""
    finest = source.select(*KEYS).distinct()
    parts = []
    for g in grains:
        own = finest.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in GRAINS[g]]))
        parts.append(own.select(F.lit(g).alias("grain"), *(F.col(k) if k in GRAINS[g] else F.lit(None).cast(KEY_TYPES[k]).alias(k) for k in KEYS)).distinct())
    return reduce(DataFrame.unionByName, parts)


def fine_baseline(grains: DataFrame) -> DataFrame:
    """BL1: fine rows with duration_count >= MIN_EVENTS."""
    return (grains.where((F.col("grain") == "fine") & (F.col("duration_count") >= C.MIN_EVENTS))
            .withColumn("match_level", F.lit("fine")).select(*BASELINE_COLUMNS))


def coarse_baseline(grains: DataFrame) -> DataFrame:
    """BL2: every coarse group; corridor null."""
    return (grains.where(F.col("grain") == "coarse")
            .withColumn("match_level", F.lit("coarse")).select(*BASELINE_COLUMNS))


def cause_baseline(grains: DataFrame) -> DataFrame:
    """BL3: one row per cause over the whole history."""
    return grains.where(F.col("grain") == "cause").select(
        "event_cause", "median_duration_minutes", "road_closure_rate", "event_count",
        "duration_count", "priority_mode")


def baseline_table(grains: DataFrame) -> DataFrame:
    """BL4: fine rows stacked on coarse rows (the stored lookup)."""
    return fine_baseline(grains).unionByName(coarse_baseline(grains))


def build_baseline_table(clean: DataFrame) -> DataFrame:
    """BL4 from cleaned incidents, fine and coarse grains only (no cause rows)."""
    return baseline_table(all_grains(clean, ("fine", "coarse")))


def station_by_corridor(clean: DataFrame) -> DataFrame:
    """BL6: most frequent police station per corridor (smallest name on ties).

    Two aggregations instead of a per-corridor ``mode`` map: counts per
    (corridor, station) first, then the best station per corridor via
    ``min_by`` over (-count, station).
    """
    c = (clean.where(F.col("corridor").isNotNull() & F.col("police_station").isNotNull())
         .groupBy("corridor", "police_station").agg(F.count(F.lit(1)).alias("_n")))
    return c.groupBy("corridor").agg(
        F.min_by("police_station", F.struct((-F.col("_n")).alias("n"), F.col("police_station").alias("s")))
        .alias("police_station"))
