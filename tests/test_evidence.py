"""Evidence lists of briefs: one list a match key, no shuffle of the incidents, one list for a repeated id."""

import datetime as dt
import re

from pyspark.sql import functions as F

from roadcast.functions import expressions as X
from roadcast.operators import evidence as EV
from roadcast.plans import QUERIES

SF = "/root/testdata/sf0.001"


def _history(spark):
    t0 = dt.datetime(2024, 1, 1)
    # 40 rows a cause; ties of a whole day, and rows without a time
    rows = [(i, None if i % 11 == 3 else t0 + dt.timedelta(hours=6 * (i // 3)), f"c{i % 2}", None if i % 17 == 5 else f"r{i % 3}",
             "High", i % 4 == 0, None if i % 5 else i + 0.4, f"s{i % 3}", "j") for i in range(80)]
    return rows, spark.createDataFrame(rows, "id long, start_datetime_ist timestamp_ntz, event_cause string, corridor string, priority string, "
                                             "requires_road_closure boolean, duration_minutes double, police_station string, junction string")


FORECASTS = [(1, "c0", "fine", "r0"), (2, "c0", "fine", "r0"), (3, "c1", "coarse", "r1"), (4, "c9", "no_data", "r1"), (5, None, "no_data", "r1"),
             (6, "c0", "fine", "r2"), (6, "c1", "cause_only", "r2"), (7, "c1", "fine", "r1"), (7, "c1", "fine", "r1"),
             (None, "c0", "fine", "r1"), (None, "c1", "coarse", "r1"), (8, "c0", "fine", "none")]


def _forecasts(spark):
    return spark.createDataFrame(FORECASTS, "incident_id long, event_cause string, match_level string, corridor string")


def _newest(rows, k, cause, corridor=None):
    own = [r for r in rows if r[2] == cause and r[3] is not None and (corridor is None or r[3] == corridor)]
    return sorted(own, key=lambda r: (-r[1].timestamp() if r[1] else float("inf"), r[0]))[:k]


def _ranked(rows, wanted, k):
    """(rank, priority-independent text of the row) of every forecast of an id, by rank and row."""
    out = []
    for _, cause, level, corridor in wanted:
        for n, r in enumerate(_newest(rows, k, cause, corridor if level == "fine" else None) if cause else []):
            out.append((n, r[1].strftime("%Y-%m-%d %H:%M:%S") if r[1] else None, r[2], r[3], r[5], "" if r[6] is None else str(round(r[6])), r[7]))
    return [x[1:] for x in sorted(out, key=lambda x: (x[0], x[1] is not None, *((y is not None, y) for y in x[1:])))]


def _got(evidence):
    return [(e["start_datetime_ist"], e["event_cause"], e["corridor"], e["requires_road_closure"], e["duration_minutes"], e["police_station"])
            for e in evidence or []]


def test_newest_rows_of_a_key_with_ties_and_missing_times(spark):
    rows, history = _history(spark)
    for k in (1, 7, 30):
        got = {}
        for r in EV.newest_k(history, ["event_cause"], k).collect():
            got.setdefault(r["event_cause"], []).append((r["evidence_rank"], r["id"]))
        for cause in ("c0", "c1"):
            own = sorted((r for r in rows if r[2] == cause), key=lambda r: (-r[1].timestamp() if r[1] else float("inf"), r[0]))[:k]
            assert sorted(got[cause]) == [(n + 1, r[0]) for n, r in enumerate(own)]


def test_lists_of_incidents_equal_brute_force_also_for_repeated_and_missing_ids(spark):
    rows, history = _history(spark)
    k = 4
    brief = EV.brief_lists(_forecasts(spark), history, k)
    lists = [(r["incident_id"], r["evidence"]) for r in EV.incident_evidence(brief).collect()]
    want = {i: _ranked(rows, [f for f in FORECASTS if f[0] == i], k) for i in {f[0] for f in FORECASTS}}
    assert sorted((i is None, i) for i, _ in lists) == sorted((i is None, i) for i, x in want.items() if x)
    assert {i: _got(e) for i, e in lists} == {i: x for i, x in want.items() if x}
    records = EV.with_evidence(brief).collect()
    assert len(records) == len(FORECASTS)
    for r in records:
        assert _got(r["evidence"]) == ([] if r["incident_id"] is None else want[r["incident_id"]])
        assert (r["evidence"] is None) == (not _got(r["evidence"]))


def test_lists_are_kept_by_key_not_by_incident(spark):
    _, history = _history(spark)
    many = spark.range(5000).select(F.col("id").alias("incident_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("event_cause"),
                                    F.lit("fine").alias("match_level"), F.concat(F.lit("r"), F.col("id") % 3).alias("corridor"))
    brief = EV.brief_lists(many, history, 8)
    assert brief.lists.count() == 6
    assert EV.incident_evidence(brief).count() == 5000


def test_brief_records_do_not_shuffle_the_incidents(spark):
    plan = QUERIES["brief_records"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"(\w*Exchange)\b", plan)) == {"BroadcastExchange"}


def test_text_laid_out_equals_slots_replaced_one_after_another(spark):
    template = "{a} on {b}: {c}{a}, [{b}] {d"
    df = spark.createDataFrame([("x", "y", 3), ("{b} and {c}", "{c}{a}", 4), ("", "{", 5), (None, "y", 6)], "a string, b string, c int")
    slots = {n: F.col(n) for n in ("a", "b", "c")}
    got = df.select(X.filled(F.lit(template), slots).alias("was"), X.laid_out(template, slots, plain=("c",)).alias("now")).collect()
    assert [r["now"] for r in got] == [r["was"] for r in got]
    assert got[1]["now"].startswith("4{a} and 4 on 4{a}: 4")


def test_long_stages_run_by_operator_but_in_the_training_data_operators(spark):
    import __spark_entry__ as entry
    limit = lambda: spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    found, before = entry.queries(), limit()
    try:
        found["op8_topk_tiles"](spark, SF)
        assert limit() == "65535"
        found["dq_summary"](spark, SF)
        assert limit() == "8000"
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)
