"""Registered queries: the budget-limited command queue (QU)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadcast.operators import queue as QU
from roadcast.plans import oracle as O
from roadcast.plans.q_deploy import REC_CTES, recommend_df
from roadcast.plans.registry import register

W = O.with_ctes

TITLE = ("array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), "
         "lambda x: upper(x[1]) || lower(x[2:])), ' ')")
CODE = ("coalesce(nullif(substr(regexp_replace(upper(event_cause), '[^A-Z0-9]', '', 'g'), 1, 6), ''), 'EVENT')")
QIN = f"""
select cast(cast(planned_start as date) as varchar) as queue_id, incident_id as input_index,
  'BTP-' || strftime(planned_start, '%Y%m%d%H%M') || '-' || {CODE} as event_id,
  {TITLE.format(c='event_cause')} || ' on ' || match_corridor as description,
  severity_tier, road_closure_probability, evidence_count, confidence_label, match_level,
  recommended_personnel_count as officers_requested,
  case when barricade_recommended then 1 else 0 end as barricades_requested
from rec
"""
SEV = ("case lower(coalesce(severity_tier, 'unknown')) when 'low' then 1.0::double when 'medium' then 2.0::double "
       "when 'high' then 3.0::double else 0.5::double end")
CLO = ("case when road_closure_probability is null or isnan(road_closure_probability) then 0.0::double "
       "else greatest(0.0::double, least(road_closure_probability, 1.0::double)) end")
LAB = "lower(trim(coalesce(confidence_label, '')))"
LEV = "lower(trim(coalesce(match_level, '')))"
CONF_BASE = (f"case when starts_with({LAB}, 'high') then 1.0::double when starts_with({LAB}, 'moderate') then 0.8::double "
             f"when starts_with({LAB}, 'low') or {LEV} = 'cause_only' then 0.55::double "
             f"when contains({LAB}, 'insufficient') or {LEV} = 'no_data' then 0.35::double else 0.5::double end")
CONF = (f"case when {LEV} = 'no_data' then least({CONF_BASE}, 0.35::double) "
        f"when {LEV} = 'cause_only' then least({CONF_BASE}, 0.55::double) else {CONF_BASE} end")
SCORED = f"""
select *, {SEV} as sev, {CLO} as clo, {CONF} as conf,
  {O.rnd(f"0.5::double * ({SEV}) + 0.35::double * ({CLO}) + 0.15::double * ({CONF})", 4)} as priority_score
from qin
"""
WIN = ("partition by queue_id order by priority_score desc, sev desc, clo desc, evidence_count desc, "
       "input_index asc")
RANKED = f"""
select *, row_number() over ({WIN}) as rank,
  coalesce(sum(officers_requested) over ({WIN} rows between unbounded preceding and 1 preceding), 0) as before_o,
  coalesce(sum(barricades_requested) over ({WIN} rows between unbounded preceding and 1 preceding), 0) as before_b
from scored
"""
ALLOC = """
select *, least(officers_requested, greatest(0, 40 - before_o)) as officers_allocated,
  least(barricades_requested, greatest(0, 6 - before_b)) as barricades_allocated
from ranked
"""
COVERED = """
select *, officers_allocated = officers_requested and barricades_allocated = barricades_requested as covered
from alloc
"""
Q_CTES = REC_CTES + [("qin", QIN), ("scored", SCORED), ("ranked", RANKED), ("alloc", ALLOC), ("cov", COVERED)]


def _queue(spark, sf_dir):
    return QU.queue_input(recommend_df(spark, sf_dir, with_text=False))


def _alloc(spark, sf_dir):
    return QU.allocate(_queue(spark, sf_dir))


@register("queue_input", W(Q_CTES, """
select queue_id, input_index, event_id, description, severity_tier, road_closure_probability, evidence_count,
  confidence_label, match_level, officers_requested, barricades_requested from qin"""))
def queue_input(spark, sf_dir):
    """QU1: queue rows from forecast + recommendation."""
    return _queue(spark, sf_dir)


@register("priority_score", W(Q_CTES, "select queue_id, input_index, priority_score from scored"))
def priority_score(spark, sf_dir):
    """QU2-QU5: priority score."""
    return QU.scored(_queue(spark, sf_dir)).select("queue_id", "input_index", "priority_score")


@register("queue_rank", W(Q_CTES, "select queue_id, input_index, rank from ranked"))
def queue_rank(spark, sf_dir):
    """QU6: rank within each queue (two-level, no single-task window)."""
    return _alloc(spark, sf_dir).select("queue_id", "input_index", "rank")


@register("queue_allocation", W(Q_CTES, """
select queue_id, rank, event_id, priority_score, officers_requested, officers_allocated, barricades_requested,
  barricades_allocated, covered,
  case when covered then '' else 'UNCOVERED RISK: ' || concat_ws('; ',
    case when officers_allocated < officers_requested then printf('only %d of %d requested officers available',
      officers_allocated, officers_requested) end,
    case when barricades_allocated < barricades_requested then printf('only %d of %d requested barricades available',
      barricades_allocated, barricades_requested) end) || ' — escalate or request mutual aid.' end as risk_flag
from cov"""))
def queue_allocation(spark, sf_dir):
    """QU7/QU8: greedy grants in closed form, coverage and risk text."""
    return _alloc(spark, sf_dir).select(
        "queue_id", "rank", "event_id", "priority_score", "officers_requested", "officers_allocated",
        "barricades_requested", "barricades_allocated", "covered", "risk_flag")


@register("queue_summary", W(Q_CTES, """
select queue_id, sum(officers_requested) as officers_requested, sum(officers_allocated) as officers_allocated,
  40 - sum(officers_allocated) as officers_remaining, sum(barricades_requested) as barricades_requested,
  sum(barricades_allocated) as barricades_allocated, 6 - sum(barricades_allocated) as barricades_remaining,
  count(*) filter (where covered) as events_covered, count(*) filter (where not covered) as events_at_risk
from cov group by queue_id"""))
def queue_summary(spark, sf_dir):
    """QU9: per-queue totals that reconcile with the budget."""
    return QU.summary(_alloc(spark, sf_dir))


#: What a queue may hold that no forecast gives: bad counts, and rows without an id or a description of their own.
PLANTED = """
select * replace (
  case when input_index % 50 = 7 then '-2' when input_index % 50 = 8 then 'many' else officers_requested::varchar end as officers_requested,
  case when input_index % 50 = 9 then null else barricades_requested end as barricades_requested,
  case when input_index % 50 = 10 then -3 else evidence_count end as evidence_count,
  case when input_index % 4 = 0 then '' when input_index % 4 = 1 then null else event_id end as event_id,
  case when input_index % 3 = 0 then '' when input_index % 3 = 1 then null else description end as description),
  case when input_index % 8 = 0 then 'own-' || input_index end as id, case when input_index % 5 = 0 then 'Label ' || input_index when input_index % 5 = 1 then '' end as label
from qin"""
BAD = "coalesce(try_cast(officers_requested as bigint), -1) < 0 or coalesce(barricades_requested, -1) < 0 or coalesce(evidence_count, -1) < 0"
P_CTES = [*Q_CTES[:-4], ("planted", PLANTED)]


def _planted(spark, sf_dir):
    i = F.col("input_index")
    return _queue(spark, sf_dir).withColumns({
        "officers_requested": F.when(i % 50 == 7, F.lit("-2")).when(i % 50 == 8, F.lit("many")).otherwise(F.col("officers_requested").cast("string")),
        "barricades_requested": F.when(i % 50 != 9, F.col("barricades_requested")),
        "evidence_count": F.when(i % 50 == 10, F.lit(-3)).otherwise(F.col("evidence_count")),
        "event_id": F.when(i % 4 == 0, F.lit("")).when(i % 4 != 1, F.col("event_id")),
        "description": F.when(i % 3 == 0, F.lit("")).when(i % 3 != 1, F.col("description")),
        "id": F.when(i % 8 == 0, F.concat(F.lit("own-"), i.cast("string"))),
        "label": F.when(i % 5 == 0, F.concat(F.lit("Label "), i.cast("string"))).when(i % 5 == 1, F.lit(""))})


@register("queue_rejects", W(P_CTES, f"""
select queue_id, input_index, event_id, officers_requested, barricades_requested, evidence_count from planted where {BAD}"""))
def queue_rejects(spark, sf_dir):
    """QU10: rows of a queue with planted faults whose counts are below 0, missing or no numbers."""
    return QU.queue_rejects(_planted(spark, sf_dir))


@register("queue_names", W([*P_CTES, ("valid", f"select * from planted where not ({BAD})"),
                            ("pscored", SCORED.replace("from qin", "from valid")), ("pranked", f"select *, row_number() over ({WIN}) as rank from pscored"),
                            ("pnamed", """
select *, coalesce(nullif(event_id, ''), nullif(id, ''), nullif(label, ''), 'incident-' || rank) as shown from pranked""")], """
select queue_id, rank, shown as event_id, coalesce(nullif(description, ''), nullif(label, ''), shown) as description from pnamed"""))
def queue_names(spark, sf_dir):
    """QU11: ids and descriptions of ranked rows, from id, label or rank where their own are missing or empty."""
    return QU.allocate(_planted(spark, sf_dir)).select("queue_id", "rank", "event_id", "description")


@register("queue_rationale")
def queue_rationale(spark, sf_dir):
    """QU11: ranked rationale line per queue row (rows-only)."""
    return _alloc(spark, sf_dir).select("queue_id", "rank", "event_id", "description", "queue_rationale")
