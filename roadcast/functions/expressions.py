"""Scalar column expressions shared by the operators.

Everything here returns a :class:`pyspark.sql.Column` built from built-in
functions, so it stays inside whole-stage codegen. Double literals are
written with ``F.lit(float)`` (DOUBLE), never SQL decimals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadcast import config as C


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: dict, key: Column, default: Column) -> Column:
    """Small fixed table as a literal map: one hash lookup instead of a CASE chain."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, key), default)


def filled(template: Column, slots: dict[str, Column]) -> Column:
    """A fixed text with its {name} slots replaced, in the order given (free text last)."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def laid_out(template: str, slots: dict[str, Column], plain: tuple = ()) -> Column:
    """``filled`` for a template known beforehand: its own text is not searched, only values that may hold later slots.

    ``plain``: slots whose values hold none (numbers, times).
    """
    names, parts = list(slots), re.split(r"\{(\w+)\}", template)
    value = {n: slots[n].cast("string") if n in plain else filled(slots[n].cast("string"), {x: slots[x] for x in names[k + 1:]})
             for k, n in enumerate(names) if n in parts[1::2]}
    return F.concat(*(value[x] if k % 2 else F.lit(x) for k, x in enumerate(parts) if x))


# --- time -------------------------------------------------------------------

def parse_timestamp(c: Column, data_type: str) -> Column:
    """Text -> TIMESTAMP (bad text -> null); NTZ -> TIMESTAMP (UTC session)."""
    if data_type == "string":
        return F.try_to_timestamp(c)
    return c.cast("timestamp")


def to_local_wallclock(ts_utc: Column, tz: str = C.LOCAL_TZ) -> Column:
    """UTC instant -> local wall clock as TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts_utc.cast("timestamp_ntz"))


def minutes_between(start: Column, end: Column) -> Column:
    """(end - start) in minutes as DOUBLE; null if either side is null."""
    return (F.unix_micros(end) - F.unix_micros(start)).cast("double") / F.lit(60000000.0)


def hour_bucket(hour: Column) -> Column:
    expr = None
    for lo, hi, label in C.HOUR_BANDS:
        cond = (hour >= lo) & (hour < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("evening"))


def weekday_mon0(ts: Column) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(ts)


def is_weekend(day_of_week: Column) -> Column:
    return day_of_week.isin(5, 6)


# --- booleans / text ---------------------------------------------------------

def truthy_text(c: Column) -> Column:
    """Text/boolean -> BOOLEAN: true/1/yes/y/closed (any case, trimmed); else false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*C.TRUE_TOKENS), F.lit(False))


def null_if_token(c: Column, tokens=tuple(C.NULL_TOKENS)) -> Column:
    return F.when(c.isin(*tokens), F.lit(None)).otherwise(c)


def title_words(c: Column) -> Column:
    """'vehicle_breakdown' -> 'Vehicle Breakdown'."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def np_round(x: Column, digits: int) -> Column:
    """Round like ``numpy.round``: half-even on ``x * 10**digits``."""
    scale = float(10 ** digits)
    # "+ 0.0" turns a negative zero (e.g. cos(3*pi/2) rounded) into 0.0
    return F.bround(x * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)


def pct0(x: Column) -> Column:
    """Fraction -> whole-percent text with half-even rounding, e.g. '13%'."""
    return F.concat(F.format_string("%d", F.bround(x * 100, 0).cast("bigint")), F.lit("%"))


def whole(x: Column) -> Column:
    """Number -> whole-number text, half-even (Python '{:.0f}')."""
    return F.format_string("%d", F.bround(x, 0).cast("bigint"))


# --- severity ----------------------------------------------------------------

def severity_by_duration(minutes: Column) -> Column:
    (c1, l1), (c2, l2) = C.SEVERITY_DURATION_CUTS
    return (F.when(minutes.isNull(), F.lit("Unknown"))
            .when(minutes < F.lit(c1), F.lit(l1))
            .when(minutes < F.lit(c2), F.lit(l2))
            .otherwise(F.lit("High")))


def priority_score(priority: Column) -> Column:
    return lookup(C.PRIORITY_SCORE, priority, F.lit(C.PRIORITY_SCORE_OTHER))


def closure_priority_score(closure_rate: Column, priority: Column) -> Column:
    return closure_rate * F.lit(C.CLOSURE_WEIGHT) + priority_score(priority) * F.lit(C.PRIORITY_WEIGHT)


def severity_by_score(score: Column) -> Column:
    expr = None
    for cut, label in C.CLOSURE_SCORE_CUTS:
        cond = score < F.lit(cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("Unknown"))


def severity_closure_priority(closure_rate: Column, priority: Column, flag: Column) -> Column:
    """Base tier by closure/priority score; null rate -> Medium if flagged else Unknown.

    Returns the tier *before* the bump; the null-rate Medium default is final
    (it is never bumped), see :func:`apply_bump`.
    """
    return (F.when(closure_rate.isNull(),
                   F.when(flag.eqNullSafe(True), F.lit("Medium")).otherwise(F.lit("Unknown")))
            .otherwise(severity_by_score(closure_priority_score(closure_rate, priority))))


def bump_tier(tier: Column) -> Column:
    return (F.when(tier == "Low", F.lit("Medium"))
            .when(tier == "Medium", F.lit("High"))
            .otherwise(tier))


def apply_bump(tier: Column, flag: Column, eligible: Column | None = None) -> Column:
    """One-step bump when the incoming closure flag is exactly true."""
    cond = flag.eqNullSafe(True) if eligible is None else flag.eqNullSafe(True) & eligible
    return F.when(cond, bump_tier(tier)).otherwise(tier)


def reliability(duration_count: Column) -> Column:
    return F.when(duration_count >= C.RELIABLE_SAMPLE_THRESHOLD, F.lit("high")).otherwise(F.lit("low"))


def confidence_label(match_level: Column, evidence_count: Column, rel: Column) -> Column:
    return (F.when(match_level == "no_data", F.lit(C.CONFIDENCE_NO_DATA))
            .when(match_level == "cause_only",
                  F.format_string(C.CONFIDENCE_CAUSE_ONLY, evidence_count, rel))
            .when(match_level.isin("fine", "coarse"),
                  F.when(evidence_count >= C.HIGH_CONFIDENCE_MIN_COUNT, F.lit(C.CONFIDENCE_HIGH))
                  .otherwise(F.lit(C.CONFIDENCE_MODERATE)))
            .otherwise(F.lit("Unknown confidence")))


def confidence_class(label: Column) -> Column:
    return (F.when(label.startswith("High"), F.lit("High"))
            .when(label.startswith("Moderate"), F.lit("Medium"))
            .when(label.startswith("Low"), F.lit("Low"))
            .otherwise(F.lit("Insufficient")))


def basis_caption(basis: Column) -> Column:
    return lookup(C.SEVERITY_CAPTIONS, basis, F.lit(C.SEVERITY_CAPTION_OTHER))


# --- deployment ----------------------------------------------------------------

PERSONNEL_BY_KEY = {f"{t}|{str(flag).lower()}": n for (t, flag), n in C.PERSONNEL_TABLE.items()}


def personnel_base(tier: Column, hard_closure: Column) -> Column:
    key = F.concat(tier, F.lit("|"), hard_closure.cast("string"))
    fallback = F.when(hard_closure, F.lit(C.PERSONNEL_TABLE[("Unknown", True)])) \
        .otherwise(F.lit(C.PERSONNEL_TABLE[("Unknown", False)]))
    return lookup(PERSONNEL_BY_KEY, key, fallback)


def soft_bump(closure_prob: Column, hard_closure: Column) -> Column:
    return (~hard_closure) & F.coalesce(closure_prob >= F.lit(C.CLOSURE_PROB_SOFT_THRESHOLD), F.lit(False))


def personnel(tier: Column, closure_prob: Column, flag: Column) -> Column:
    hard = F.coalesce(flag, F.lit(False))
    return personnel_base(tier, hard) + F.when(soft_bump(closure_prob, hard),
                                               F.lit(C.CLOSURE_PROB_SOFT_EXTRA)).otherwise(F.lit(0))


def barricade(tier: Column, closure_prob: Column, flag: Column) -> Column:
    return (tier.isin(*C.BARRICADE_SEVERITY_TIERS)
            | F.coalesce(closure_prob >= F.lit(C.BARRICADE_PROBABILITY_THRESHOLD), F.lit(False))
            | flag.eqNullSafe(True))


def _present(c: Column, *absent: str) -> Column:
    t = F.lower(F.trim(c))
    return c.isNotNull() & ~t.isin("", *absent)


def barricade_location(junction: Column, address: Column, corridor: Column) -> Column:
    return (F.when(_present(junction, "unknown"), F.concat(junction, F.lit(" junction")))
            .when(address.isNotNull() & (F.trim(address) != ""),
                  F.concat(F.lit("near "), F.substring(address, 1, C.ADDRESS_HINT_CHARS)))
            .when(_present(corridor, "non-corridor"), F.concat(F.lit("along "), corridor))
            .otherwise(F.lit(C.GENERIC_LOCATION_HINT)))


def severity_proxy(minutes: Column) -> Column:
    return severity_by_duration(minutes)


def incident_code(cause: Column, start: Column, prefix: str = C.INCIDENT_ID_PREFIX) -> Column:
    code = F.substring(F.regexp_replace(F.upper(cause), r"[^A-Z0-9]", ""), 1, 6)
    code = F.when(code == "", F.lit("EVENT")).otherwise(code)
    return F.concat_ws("-", F.lit(prefix), F.date_format(start, "yyyyMMddHHmm"), code)
