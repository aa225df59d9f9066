"""Budget-limited command queue (QU1-QU11).

The reference ranks the incidents of a queue and walks them greedily,
granting ``min(requested, remaining)``. Because a grant only ever stops
when the budget is exhausted, the walk has a closed form:

    allocated_i = least(requested_i, greatest(0, budget - sum(requested_j, j ranked before i)))

so allocation is a ranked exclusive running sum followed by a projection.
The running sum is that of :func:`roadcast.operators.ranking.rank_rows`, balanced even for one enormous queue. Budgets come
from a per-queue table (one row per queue) or a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.functions import expressions as X
from roadcast.operators.ranking import rank_rows
from roadcast.operators.sizing import materialize



def order_cols() -> list[str]:
    """Score, severity, closure, evidence descending; input order ascending."""
    return ["priority_score desc", "_sev desc", "_closure desc", "evidence_count desc", "input_index"]


def queue_input(rec: DataFrame) -> DataFrame:
    """QU1: queue rows from forecast + recommendation (queue = start date)."""
    return rec.select(
        F.to_date("planned_start").cast("string").alias("queue_id"),
        F.col("incident_id").alias("input_index"),
        X.incident_code(F.col("event_cause"), F.col("planned_start")).alias("event_id"),
        F.concat(X.title_words(F.col("event_cause")), F.lit(" on "), F.col("corridor")).alias("description"),
        "severity_tier", "road_closure_probability", "evidence_count", "confidence_label", "match_level",
        F.col("recommended_personnel_count").alias("officers_requested"),
        F.when(F.col("barricade_recommended"), F.lit(1)).otherwise(F.lit(0)).alias("barricades_requested"),
    )


def severity_score(tier: Column) -> Column:
    """QU2: Low 1 / Medium 2 / High 3 / Unknown 0.5, case-insensitive; other 0.5."""
    t = F.initcap(F.coalesce(tier.cast("string"), F.lit("Unknown")))
    return X.lookup(C.QUEUE_SEVERITY_SCORE, t, F.lit(0.5))


def closure_score(p: Column) -> Column:
    """QU3: to [0, 1]; null, bad text and NaN -> 0."""
    v = p.cast("string").try_cast("double")
    v = F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(v, F.lit(1.0)))


def confidence_score(label: Column, level: Column) -> Column:
    """QU4: score by label prefix, capped by match level."""
    lab = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit(""))))
    lev = F.lower(F.trim(F.coalesce(level.cast("string"), F.lit(""))))
    S = C.QUEUE_CONFIDENCE_SCORE
    base = (F.when(lab.startswith("high"), F.lit(S["high"]))
            .when(lab.startswith("moderate"), F.lit(S["moderate"]))
            .when(lab.startswith("low") | (lev == "cause_only"), F.lit(S["low"]))
            .when(lab.contains("insufficient") | (lev == "no_data"), F.lit(S["insufficient"]))
            .otherwise(F.lit(S["unknown"])))
    cap = (F.when(lev == "no_data", F.lit(S["insufficient"]))
           .when(lev == "cause_only", F.lit(S["low"])).otherwise(F.lit(S["high"])))
    return F.least(base, cap)  # base <= 1.0, so the cap only bites on the two thin tiers


def scored(q: DataFrame) -> DataFrame:
    """QU5 + QU10: priority score, and a validity flag for the counts."""
    def nonneg(c):
        v = F.col(c).cast("string").try_cast("bigint")
        return v
    df = q.withColumns({
        "_sev": severity_score(F.col("severity_tier")),
        "_closure": closure_score(F.col("road_closure_probability")),
        "_conf": confidence_score(F.col("confidence_label"), F.col("match_level")),
        "_officers": nonneg("officers_requested"),
        "_barricades": nonneg("barricades_requested"),
        "_evidence": nonneg("evidence_count"),
    })
    df = df.withColumn("priority_score", X.np_round(
        F.lit(C.QUEUE_SEVERITY_WEIGHT) * F.col("_sev") + F.lit(C.QUEUE_CLOSURE_WEIGHT) * F.col("_closure")
        + F.lit(C.QUEUE_CONFIDENCE_WEIGHT) * F.col("_conf"), 4))
    valid = F.col("_officers").isNotNull() & (F.col("_officers") >= 0) & F.col("_barricades").isNotNull() \
        & (F.col("_barricades") >= 0) & F.col("_evidence").isNotNull() & (F.col("_evidence") >= 0)
    return df.withColumn("_valid", valid)


def queue_rejects(q: DataFrame) -> DataFrame:
    """QU10: rows whose counts are not integers >= 0 (kept out of the allocation)."""
    s = scored(q).where(~F.col("_valid"))
    return s.select("queue_id", "input_index", "event_id", "officers_requested", "barricades_requested",
                    "evidence_count")


def allocate(q: DataFrame, budgets: DataFrame | None = None,
             officers: int = C.QUEUE_DEFAULT_OFFICERS, barricades: int = C.QUEUE_DEFAULT_BARRICADES) -> DataFrame:
    """QU6-QU8, QU11: rank, greedy grants (closed form), coverage and risk text."""
    s = scored(q).where(F.col("_valid")).withColumns({
        "officers_requested": F.col("_officers"), "barricades_requested": F.col("_barricades"),
        "evidence_count": F.col("_evidence")})
    r = rank_rows(s, ["queue_id"], order_cols(), ["officers_requested", "barricades_requested"])
    if budgets is not None:
        r = r.join(materialize(budgets.select("queue_id", "total_officers", "total_barricades"), "budgets"), "queue_id", "left")
    else:
        r = r.withColumns({"total_officers": F.lit(officers), "total_barricades": F.lit(barricades)})

    def grant(req, before, total):
        return F.least(F.col(req), F.greatest(F.lit(0), F.col(total) - F.col(before))).cast("int")

    r = r.withColumns({
        "officers_allocated": grant("officers_requested", "before_officers_requested", "total_officers"),
        "barricades_allocated": grant("barricades_requested", "before_barricades_requested", "total_barricades"),
    })
    covered = (F.col("officers_allocated") == F.col("officers_requested")) & \
              (F.col("barricades_allocated") == F.col("barricades_requested"))
    gaps = F.concat_ws("; ",
                       F.when(F.col("officers_allocated") < F.col("officers_requested"), F.format_string(
                           "only %d of %d requested officers available", F.col("officers_allocated"),
                           F.col("officers_requested"))),
                       F.when(F.col("barricades_allocated") < F.col("barricades_requested"), F.format_string(
                           "only %d of %d requested barricades available", F.col("barricades_allocated"),
                           F.col("barricades_requested"))))
    event_id = F.coalesce(_text(r, "event_id"), _text(r, "id"), _text(r, "label"), F.format_string("incident-%d", F.col("rank")))
    conf_short = F.lower(F.trim(F.split(F.coalesce(F.col("confidence_label"), F.lit("unknown confidence")),
                                        "—", 2).getItem(0)))
    rationale = F.concat(
        F.lit("Ranked #"), F.col("rank").cast("string"), F.lit(": "),
        F.initcap(F.coalesce(F.col("severity_tier"), F.lit("Unknown"))), F.lit(" severity, "),
        X.pct0(F.col("_closure")), F.lit(" historical closure rate, "), conf_short, F.lit(" evidence ("),
        F.col("evidence_count").cast("string"), F.lit(" events), priority score "),
        F.format_string("%.2f", F.bround(F.col("priority_score"), 2)), F.lit("."))
    return r.withColumns({
        "covered": covered,
        "risk_flag": F.when(covered, F.lit("")).otherwise(
            F.concat(F.lit("UNCOVERED RISK: "), gaps, F.lit(" — escalate or request mutual aid."))),
        "event_id": event_id,
        "description": F.coalesce(_text(r, "description"), _text(r, "label"), event_id),
        "queue_rationale": rationale,
    })


def _text(df: DataFrame, name: str) -> Column:
    """A column as text; null where it is empty or the table has none of that name."""
    return F.nullif(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def summary(alloc: DataFrame) -> DataFrame:
    """QU9: requested / allocated / remaining, covered and at-risk counts per queue."""
    return alloc.groupBy("queue_id").agg(
        F.sum("officers_requested").alias("officers_requested"),
        F.sum("officers_allocated").alias("officers_allocated"),
        (F.max("total_officers") - F.sum("officers_allocated")).alias("officers_remaining"),
        F.sum("barricades_requested").alias("barricades_requested"),
        F.sum("barricades_allocated").alias("barricades_allocated"),
        (F.max("total_barricades") - F.sum("barricades_allocated")).alias("barricades_remaining"),
        F.count_if("covered").alias("events_covered"),
        F.count_if(~F.col("covered")).alias("events_at_risk"),
    )
