"""Deployment recommendation and public advisory (DP1-DP7, AD1-AD4).

All columns are expressions over the forecast; the only join is the
corridor -> usual police station lookup (one row per corridor, broadcast
behind a row-count check).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.functions import expressions as X
from roadcast.operators.sizing import broadcast_if_small

VMS_PATTERN = r"(?s)VMS SIGNBOARD MESSAGE:\s*\n\[\s*(.*?)\s*\]"


def _corridor_named(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(c).isin("non-corridor", "none", "")


def _rationale_texts() -> dict[str, str]:
    """Whole paragraphs with slots, one for each severity basis, closure state and barricade decision."""
    basis = {"duration": C.RATIONALE_BY_DURATION, "figure": C.RATIONALE_BY_CLOSURE.replace("{figure}", C.RATIONALE_FIGURE),
             "closure": C.RATIONALE_BY_CLOSURE.replace("{figure}", "")}
    closure = {"confirmed": C.RATIONALE_CLOSURE_CONFIRMED, "likely": C.RATIONALE_CLOSURE_LIKELY, "none": ""}
    barricade = {"true": C.RATIONALE_BARRICADE, "false": C.RATIONALE_NO_BARRICADE}
    return {f"{b}|{c}|{r}": C.RATIONALE_OPENING + basis[b] + C.RATIONALE_CONFIDENCE + closure[c] + C.RATIONALE_OFFICERS + barricade[r]
            for b in basis for c in closure for r in barricade}


def rationale(df: DataFrame) -> Column:
    """DP5: plain-language rationale: a paragraph chosen by its three states, then filled."""
    minutes, rate, corridor = F.col("expected_duration_minutes"), F.col("road_closure_probability"), F.col("corridor_input")
    likely = F.coalesce(rate >= F.lit(C.CLOSURE_PROB_SOFT_THRESHOLD), F.lit(False))
    state = F.concat_ws(
        "|",
        F.when(F.col("severity_basis") == "duration", "duration").when(minutes.isNotNull(), "figure").otherwise("closure"),
        F.when(F.col("requires_road_closure").eqNullSafe(True), "confirmed").when(likely, "likely").otherwise("none"),
        F.col("barricade_recommended").cast("string"))
    length = F.when(minutes.isNotNull(), C.RATIONALE_LENGTH).otherwise(C.RATIONALE_NO_LENGTH)
    place = F.when(_corridor_named(corridor), C.RATIONALE_PLACE).otherwise("")
    return X.filled(X.lookup(_rationale_texts(), state, F.lit(None).cast("string")), {
        "length": length, "place": place,
        "evidence": F.col("evidence_count"), "timed": F.col("duration_count"), "tier": F.col("severity_tier"),
        "minutes": F.when(minutes.isNotNull(), X.whole(minutes)).otherwise(""),
        "rate": F.when(rate.isNotNull(), X.pct0(rate)).otherwise(C.RATIONALE_NO_RATE),
        "officers": F.col("recommended_personnel_count"), "confidence": F.col("confidence_label"),
        "cause": F.replace(F.col("event_cause"), F.lit("_"), F.lit(" ")), "corridor": F.coalesce(corridor, F.lit("")),
    })


def recommend(fc: DataFrame, with_text: bool = True) -> DataFrame:
    """DP7: staffing, barricade, location hint, diversion, rationale."""
    tier, rate, flag = F.col("severity_tier"), F.col("road_closure_probability"), F.col("requires_road_closure")
    junction = F.col("junction") if "junction" in fc.columns else F.lit(None).cast("string")
    address = F.col("address") if "address" in fc.columns else F.lit(None).cast("string")
    corridor_in = F.col("corridor_input") if "corridor_input" in fc.columns else F.col("corridor")
    df = fc.withColumns({
        "recommended_personnel_count": X.personnel(tier, rate, flag),
        "barricade_recommended": X.barricade(tier, rate, flag),
        "barricade_location_hint": X.barricade_location(junction, address, corridor_in),
    })
    if with_text:
        if "corridor_input" not in df.columns:
            df = df.withColumn("corridor_input", F.col("corridor"))
        df = df.withColumns({
            "diversion_suggestion": F.lit(C.DIVERSION_DISCLAIMER),
            "rationale": rationale(df),
            "recommendation_notes": F.array_compact(F.array(F.when(
                X.soft_bump(rate, F.coalesce(flag, F.lit(False))),
                X.filled(F.lit(C.SOFT_BUMP_NOTE), {
                    "extra": F.lit(C.CLOSURE_PROB_SOFT_EXTRA), "rate": X.pct0(rate),
                    "threshold": F.lit(int(C.CLOSURE_PROB_SOFT_THRESHOLD * 100))})))),
        })
    return df


# --- advisory -------------------------------------------------------------------

def _plus_minutes(ts: Column, minutes: Column) -> Column:
    secs = (F.round(minutes * F.lit(60000000.0)).cast("decimal(38,0)") / F.lit(1000000)).cast("decimal(18,6)")
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def _has_window(dur: Column) -> Column:
    return dur.isNotNull() & (dur != F.lit(0.0)) & ~F.isnan(dur)


def advisory_window(df: DataFrame, start: str = "planned_start") -> DataFrame:
    """AD1: 'hh:mm a to hh:mm a' or 'starting at hh:mm a'."""
    s, dur = F.col(start), F.col("expected_duration_minutes")
    end = _plus_minutes(s, dur)
    return df.withColumns({
        "window_end": F.when(_has_window(dur), end),
        "time_range": F.when(_has_window(dur), F.concat(F.date_format(s, "hh:mm a"), F.lit(" to "),
                                                        F.date_format(end, "hh:mm a")))
        .otherwise(F.concat(F.lit("starting at "), F.date_format(s, "hh:mm a"))),
    })


def _given(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), c)


def _closed() -> Column:
    return F.col("barricade_recommended") | F.coalesce(F.col("requires_road_closure"), F.lit(False))


def vms_message(df: DataFrame, start: str = "planned_start") -> Column:
    """AD2: sign-board text, upper case, at most 100 characters."""
    begin, minutes = F.col(start), F.col("expected_duration_minutes")
    clock = "hh:mma"
    until = F.date_format(_plus_minutes(begin, minutes), clock)
    span = F.when(_has_window(minutes), F.concat_ws("-", F.date_format(begin, clock), until)) \
        .otherwise(F.concat(F.lit("FROM "), F.date_format(begin, clock)))
    text = X.filled(F.when(_closed(), C.SIGN_CLOSED).otherwise(C.SIGN_OPEN), {
        "span": span, "event": F.replace(F.col("event_cause"), F.lit("_"), F.lit(" ")),
        "road": F.coalesce(_given(F.col("corridor_input")), F.lit("ROAD"))})
    cut = F.concat(F.left(text, F.lit(C.VMS_MAX_CHARS - 3)), F.lit("..."))
    return F.upper(F.when(F.length(text) > C.VMS_MAX_CHARS, cut).otherwise(text))


def advisory(rec: DataFrame, stations: DataFrame, start: str = "planned_start") -> DataFrame:
    """AD3: the advisory text block per incident (station from BL6)."""
    beats = broadcast_if_small(stations.select(F.col("corridor").alias("_beat_corridor"), F.col("police_station").alias("_beat")))
    df = rec.join(beats, rec["corridor_input"] == beats["_beat_corridor"], "left")
    corridor = _given(F.col("corridor_input"))
    beat = F.when(corridor != "Non-corridor", X.filled(F.lit(C.ADVISORY_STATION), {"name": F.col("_beat")}))
    place = F.coalesce(corridor, F.lit("Non-corridor"))
    df = advisory_window(df, start).withColumns({"vms_message": vms_message(df, start)})
    title = X.laid_out(C.ADVISORY_TITLE, {"date": F.date_format(F.col(start), "yyyy-MM-dd"),
                                          "event": X.title_words(F.col("event_cause")), "place": place}, plain=("date",))
    plain = ("window", "officers")
    slots = {"window": F.col("time_range"), "officers": F.col("recommended_personnel_count"),
             "station": F.coalesce(beat, F.lit(C.DEFAULT_STATION)), "title": title, "sign": F.col("vms_message"), "place": place}
    movement = F.when(_closed(), X.laid_out(C.ADVISORY_CLOSED, slots, plain)).otherwise(X.laid_out(C.ADVISORY_OPEN, slots, plain))
    text = X.laid_out(C.ADVISORY_LAYOUT, {
        "movement": movement, "staff": X.laid_out(C.ADVISORY_STAFF, slots, plain), "rule": F.repeat(F.lit("="), F.length(title)),
        **slots}, plain=("movement", "staff", "rule", *plain))
    return df.withColumn("advisory_text", text).drop("_beat_corridor", "_beat")


def extract_vms(text: Column) -> Column:
    """AD4: recover the sign-board message from an advisory text."""
    return F.when(text.rlike(VMS_PATTERN), F.trim(F.regexp_extract(text, VMS_PATTERN, 1))) \
        .otherwise(F.lit("See advisory text"))
