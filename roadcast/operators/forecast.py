"""Forecast (FC1-FC11): scalar expressions over the tier-chain result.

No UDF and no collect: the whole forecast is one projection after the three
broadcast joins of :mod:`roadcast.operators.match`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.functions import expressions as X
from roadcast.operators.match import Baselines, incoming_features, tiered_match

FORECAST_COLUMNS = ["incident_id", "event_cause", "corridor", "requires_road_closure",
                    "start_local", "hour_bucket", "is_weekend", "match_level",
                    "expected_duration_minutes", "road_closure_probability", "severity_tier",
                    "evidence_count", "duration_count", "duration_reliability",
                    "confidence_label", "severity_basis", "priority_mode"]


def severity_columns(df: DataFrame, flag: str = "requires_road_closure") -> DataFrame:
    """FC1-FC5 on a frame holding the matched statistics."""
    fl = F.col(flag)
    med, rate = F.col("median_duration_minutes"), F.col("road_closure_rate")
    rel = X.reliability(F.col("duration_count"))
    df = df.withColumn("duration_reliability", rel)
    use_duration = (F.col("duration_reliability") == "high") & med.isNotNull()
    no_data = F.col("match_level") == "no_data"
    base = (F.when(no_data, F.lit("Unknown"))
            .when(use_duration, X.severity_by_duration(med))
            .otherwise(X.severity_closure_priority(rate, F.col("priority_mode"), fl)))
    df = df.withColumns({
        "severity_basis": F.when(no_data, F.lit("unknown"))
        .when(use_duration, F.lit("duration")).otherwise(F.lit("closure_priority")),
        "_base_tier": base,
        "_score": F.when(~no_data & ~use_duration & rate.isNotNull(),
                         X.closure_priority_score(rate, F.col("priority_mode"))),
    })
    bump_ok = ~no_data & (use_duration | rate.isNotNull())
    return df.withColumns({
        "severity_tier": X.apply_bump(F.col("_base_tier"), fl, bump_ok),
        "confidence_label": X.confidence_label(F.col("match_level"), F.col("evidence_count"),
                                               F.col("duration_reliability")),
        "expected_duration_minutes": med,
        "road_closure_probability": rate,
    })


def notes_column(df: DataFrame, flag: str = "requires_road_closure") -> DataFrame:
    """FC7: explanation notes as ARRAY<STRING> (empty entries compacted away)."""
    fl = F.col(flag)
    basis = F.col("severity_basis")
    bumped = F.col("severity_tier") != F.col("_base_tier")
    bump_note = F.when(bumped & (F.col("match_level") != "no_data") & ~(
        (basis == "closure_priority") & F.col("road_closure_probability").isNull()),
        F.format_string(C.NOTE_BUMP, F.col("_base_tier"), F.col("severity_tier")))
    thin = F.when(basis == "closure_priority", F.format_string(C.NOTE_THIN_SAMPLE, F.col("duration_count")))
    closure_default = F.when((basis == "closure_priority") & F.col("road_closure_probability").isNull()
                             & fl.eqNullSafe(True), F.lit(C.NOTE_CLOSURE_DEFAULT))
    score = F.when(F.col("_score").isNotNull(), F.format_string(
        C.NOTE_SCORE, F.format_string("%.2f", F.bround(F.col("_score"), 2)),
        X.pct0(F.col("road_closure_probability")), F.col("priority_mode")))
    no_hist = F.when(F.col("match_level") == "no_data", F.lit(C.NOTE_NO_HISTORY))
    return df.withColumn("notes", F.array_compact(F.array(no_hist, thin, closure_default, score, bump_note)))


def forecast(incoming: DataFrame, base: Baselines, with_notes: bool = False) -> DataFrame:
    """FC6: one forecast row per incoming incident."""
    m = tiered_match(incoming_features(incoming), base)
    m = m.withColumns({"corridor_input": F.col("corridor"), "corridor": F.col("match_corridor")})
    f = severity_columns(m)
    cols = list(FORECAST_COLUMNS)
    extra = [c for c in incoming.columns if c not in cols and c not in ("planned_start",)]
    extra.append("corridor_input")
    if with_notes:
        f = notes_column(f)
        cols.append("notes")
    return f.select(*cols, "planned_start", *extra)
