"""Verified outcomes: normalise, key, accept, convert, refresh (FB1-FB7).

Keeping two reference behaviours apart (see SURVEY S12):
* :func:`accept` - a submission is refused when its outcome key is already
  in the log, whatever its status, so a verified resubmission of an
  unverified outcome is refused;
* :func:`feedback_events` - the refresh keeps verified rows first and then
  the first row per key.

Duplicate handling is an aggregation (``min_by`` per key), not a window:
partial aggregation bounds the work even when one key is resubmitted a huge
number of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.functions import expressions as X
from roadcast.operators import baseline as BL
from roadcast.operators.sizing import materialize, materialize

FEEDBACK_SCHEMA = ["timestamp", "event_datetime", "event_cause", "corridor", "actual_duration_minutes",
                   "actual_requires_road_closure", "priority", "verified_by", "verification_status"]


def normalise_corridor(c: Column) -> Column:
    t = F.trim(c)
    return F.when(c.isNull() | (t == "") | (F.lower(t) == "unknown"), F.lit("Non-corridor")).otherwise(t)


def normalise_status(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("unverified"))))
    return F.when(s.isin(*C.VALID_VERIFICATION_STATUSES), s).otherwise(F.lit("unverified"))


def _to_ts(c: Column, dtype: str) -> Column:
    if dtype == "string":
        return F.try_to_timestamp(c)
    return c.cast("timestamp")


def align_layout(df: DataFrame) -> DataFrame:
    """SC6: old layouts -> current one (renamed columns, defaults for missing ones)."""
    cols = set(df.columns)
    if "actual_requires_road_closure" not in cols and "requires_road_closure" in cols:
        df = df.withColumn("actual_requires_road_closure", F.col("requires_road_closure"))
    if "event_datetime" not in cols and "timestamp" in cols:
        df = df.withColumn("event_datetime", F.col("timestamp"))
    if "timestamp" not in df.columns and "logged_at" in df.columns:
        df = df.withColumn("timestamp", F.col("logged_at"))
    defaults = {"verification_status": F.lit("unverified"), "priority": F.lit("Unknown"),
                "verified_by": F.lit(""), "actual_requires_road_closure": F.lit(False)}
    for c in FEEDBACK_SCHEMA:
        if c not in df.columns:
            df = df.withColumn(c, defaults.get(c, F.lit(None).cast("string")))
    return df


def normalise(log: DataFrame) -> DataFrame:
    """FB1: corridor, status, closure flag, duration, time, priority, verifier."""
    df = align_layout(log)
    types = dict(df.dtypes)
    return df.withColumns({
        "timestamp": _to_ts(F.col("timestamp"), types["timestamp"]),
        "event_datetime": _to_ts(F.col("event_datetime"), types["event_datetime"]),
        "corridor": normalise_corridor(F.col("corridor")),
        "actual_requires_road_closure": X.truthy_text(F.col("actual_requires_road_closure")),
        "verification_status": normalise_status(F.col("verification_status")),
        "priority": F.coalesce(F.col("priority").cast("string"), F.lit("Unknown")),
        "verified_by": F.coalesce(F.col("verified_by").cast("string"), F.lit("")),
        "actual_duration_minutes": F.col("actual_duration_minutes").cast("string").try_cast("double"),
    })


def iso_text(ts: Column) -> Column:
    """``datetime.isoformat()``: seconds, plus .ffffff only when micros are set."""
    frac = F.pmod(F.unix_micros(ts), F.lit(1000000))
    return F.when(ts.isNull(), F.lit("")).otherwise(F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac != 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))).otherwise(F.lit(""))))


def outcome_key(df: DataFrame) -> Column:
    """FB2: sha-256 of the operational outcome fields (normalised frame)."""
    dur = F.col("actual_duration_minutes")
    raw = F.concat_ws("|",
                      iso_text(F.col("event_datetime")),
                      F.lower(F.trim(F.coalesce(F.col("event_cause"), F.lit("")))),
                      F.lower(normalise_corridor(F.col("corridor"))),
                      F.when(dur.isNull() | F.isnan(dur), F.lit("")).otherwise(F.format_string("%.4f", dur)),
                      F.when(F.col("actual_requires_road_closure"), F.lit("True")).otherwise(F.lit("False")),
                      F.lower(F.trim(F.col("priority"))))
    return F.sha2(raw, 256)


def keyed(log: DataFrame) -> DataFrame:
    n = normalise(log)
    return n.withColumn("feedback_key", outcome_key(n))


def _order_cols(df: DataFrame) -> list[str]:
    return [c for c in ("timestamp", "log_seq") if c in df.columns]


def accept(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """FB3: first submission per key in the batch, minus keys already logged."""
    k = keyed(new)
    order = F.struct(*[F.col(c) for c in _order_cols(k)])
    first = k.groupBy("feedback_key").agg(F.min_by(F.struct(*k.columns), order).alias("_r")).select("_r.*")
    if existing is not None:
        logged = existing if "feedback_key" in existing.columns else keyed(existing)  # a stored log keeps its keys
        first = first.join(logged.select("feedback_key").distinct(), "feedback_key", "left_anti")
    return first


def submissions(log: DataFrame) -> DataFrame:
    """FB3 over a whole log in order: each row accepted iff no earlier row has its key."""
    k = keyed(log)
    order_cols = _order_cols(k)
    # A stored table: the join has a plain exchange on either side, so a key submitted very often is split at run time.
    firsts = materialize(k.groupBy("feedback_key").agg(F.min(F.struct(*order_cols)).alias("_first")), "firsts")
    j = k.join(firsts, "feedback_key")
    return j.withColumn("accepted", F.struct(*order_cols) == F.col("_first")).drop("_first")


def feedback_events(log: DataFrame) -> DataFrame:
    """FB4: verified outcomes -> cleaned-incident-shaped rows."""
    k = keyed(log).where(F.col("verification_status") == "verified")
    order = F.struct(*[F.col(c) for c in _order_cols(k)])
    v = k.groupBy("feedback_key").agg(F.min_by(F.struct(*k.columns), order).alias("_r")).select("_r.*")
    v = v.where(F.col("event_datetime").isNotNull() & F.col("event_cause").isNotNull())
    dur = F.col("actual_duration_minutes")
    has = dur.isNotNull() & ~F.isnan(dur) & (dur >= 0)
    start = F.col("event_datetime")
    ev = v.select(
        F.concat(F.lit("feedback:"), F.col("feedback_key")).alias("id"),
        F.lit(C.FEEDBACK_EVENT_TYPE).alias("event_type"),
        F.col("event_cause").cast("string").alias("event_cause"),
        normalise_corridor(F.col("corridor")).alias("corridor"),
        "priority",
        F.col("actual_requires_road_closure").alias("requires_road_closure"),
        start.alias("start_datetime"),
        start.cast("timestamp_ntz").alias("start_datetime_ist"),
        F.when(has, dur).alias("duration_minutes"),
        has.alias("has_duration"),
        F.hour(start.cast("timestamp_ntz")).alias("hour_of_day"),
        X.weekday_mon0(start.cast("timestamp_ntz")).alias("day_of_week"),
    )
    return ev.withColumns({"is_weekend": X.is_weekend(F.col("day_of_week")),
                           "hour_bucket": X.hour_bucket(F.col("hour_of_day"))})


def combined_history(clean: DataFrame, events: DataFrame) -> DataFrame:
    """FB5: cleaned incidents + feedback rows; missing columns null; ids as text."""
    c = clean.withColumn("id", F.col("id").cast("string"))
    return c.unionByName(events, allowMissingColumns=True)


#: Causes named in a filter that the scan of the counts can use; with more, a semi join.
NAMED_CAUSES = 1000


def refresh_baseline(old_grains: DataFrame, state: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FB6: (new grains, counts to add to the state) from counted values and the newly verified outcomes.

    ``state`` has the value counts of all incidents so far (:func:`roadcast.operators.baseline.value_counts`; rows of one
    value add up). Groups that the events touch are computed from the counts of the touched causes, old and new; all
    others are carried over. The history isn't read.
    """
    delta = materialize(BL.value_counts(events), "delta")
    touched = materialize(BL.touched_groups(delta), "touched")
    causes = touched.where(F.col("grain") == "cause").select(F.col("event_cause").alias("_cause"))
    named = [r["_cause"] for r in causes.limit(NAMED_CAUSES + 1).collect()]
    if len(named) <= NAMED_CAUSES:
        near = state.where(F.col("event_cause").isin(named))
    else:
        near = state.join(causes, state["event_cause"] == causes["_cause"], "left_semi")
    new = BL.grains_of(near.select(*BL.SOURCE).unionByName(delta), only=touched)
    kept = old_grains.join(touched, [old_grains[k].eqNullSafe(touched[k]) for k in ["grain", *BL.KEYS]], "left_anti")
    return kept.unionByName(new.select(*old_grains.columns)), delta
