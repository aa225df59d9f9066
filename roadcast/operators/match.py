"""Incoming incidents -> tier chain fine -> coarse -> cause_only -> no_data.

The three baseline grains are written once, each as a table of its own, so
the planner decides per tier by bytes: coarse and cause grains have a handful
of rows and are always broadcast; while the fine one is too, the incoming side is not shuffled. Each tier is a
left equi-join; the chosen tier is ``coalesce`` over one STRUCT per tier, so
the fields of different tiers can never mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.functions import expressions as X
from roadcast.operators import baseline as B
from roadcast.operators.sizing import materialize

STAT_FIELDS = ["median_duration_minutes", "road_closure_rate", "event_count",
               "duration_count", "priority_mode"]


@dataclass
class Baselines:
    """The three lookup grains, ready to join."""
    fine: DataFrame
    coarse: DataFrame
    cause: DataFrame


def prepare_baselines(clean: DataFrame) -> Baselines:
    """Aggregate all grains once."""
    return baselines_from_grains(B.all_grains(clean))


def baselines_from_grains(grains: DataFrame) -> Baselines:
    """Split a grain-tagged aggregate (e.g. a refreshed one) into three stored tiers, each joined by its own size."""
    grains = materialize(grains, "grains")
    return Baselines(
        fine=materialize(B.fine_baseline(grains), "fine"),
        coarse=materialize(B.coarse_baseline(grains).where(F.col("duration_count") >= C.MIN_EVENTS), "coarse"),
        cause=materialize(B.cause_baseline(grains), "cause"),
    )


def incoming_features(incoming: DataFrame, start_col: str = "planned_start") -> DataFrame:
    """MT1: NTZ start = IST wall clock; TIMESTAMP start = UTC instant -> IST."""
    dtype = dict(incoming.dtypes)[start_col]
    local = F.col(start_col) if dtype == "timestamp_ntz" else X.to_local_wallclock(F.col(start_col))
    corridor = F.when(F.col("corridor").isNull() | (F.col("corridor") == ""), F.lit("Non-corridor")) \
        .otherwise(F.col("corridor"))
    return incoming.withColumns({
        "start_local": local,
        "match_corridor": corridor,
    }).withColumns({
        "hour_of_day": F.hour("start_local"),
        "day_of_week": X.weekday_mon0(F.col("start_local")),
    }).withColumns({
        "is_weekend": X.is_weekend(F.col("day_of_week")),
        "hour_bucket": X.hour_bucket(F.col("hour_of_day")),
    })


def _tier(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys],
                     F.struct(*STAT_FIELDS).alias(f"_{name}"))


def tiered_match(feats: DataFrame, base: Baselines) -> DataFrame:
    """MT2-MT6: adds ``match_level`` and the chosen tier's statistics."""
    fine = _tier(base.fine, B.GRAINS["fine"], "f")
    coarse = _tier(base.coarse, B.GRAINS["coarse"], "c")
    cause = _tier(base.cause, B.GRAINS["cause"], "k")
    j = feats.join(fine, (feats["match_corridor"] == fine["_f_corridor"])
                   & (feats["event_cause"] == fine["_f_event_cause"])
                   & (feats["is_weekend"] == fine["_f_is_weekend"])
                   & (feats["hour_bucket"] == fine["_f_hour_bucket"]), "left")
    j = j.join(coarse, (j["event_cause"] == coarse["_c_event_cause"])
               & (j["is_weekend"] == coarse["_c_is_weekend"])
               & (j["hour_bucket"] == coarse["_c_hour_bucket"]), "left")
    j = j.join(cause, j["event_cause"] == cause["_k_event_cause"], "left")
    level = (F.when(F.col("_f").isNotNull(), F.lit("fine"))
             .when(F.col("_c").isNotNull(), F.lit("coarse"))
             .when(F.col("_k").isNotNull(), F.lit("cause_only"))
             .otherwise(F.lit("no_data")))
    chosen = F.coalesce(F.col("_f"), F.col("_c"), F.col("_k"))
    out = j.withColumns({"match_level": level, "_m": chosen})
    drop = [c for c in out.columns if c.startswith(("_f", "_c", "_k"))]
    out = out.drop(*drop)
    return out.withColumns({
        "median_duration_minutes": F.col("_m.median_duration_minutes"),
        "road_closure_rate": F.col("_m.road_closure_rate"),
        "evidence_count": F.coalesce(F.col("_m.event_count"), F.lit(0)).cast("bigint"),
        "duration_count": F.coalesce(F.col("_m.duration_count"), F.lit(0)).cast("bigint"),
        "priority_mode": F.coalesce(F.col("_m.priority_mode"), F.lit("Unknown")),
    }).drop("_m")
