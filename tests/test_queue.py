"""Command-queue cases restated over DataFrames (budget, order, partial grant, totals)."""

import random

import pytest
from pyspark.sql import functions as F

from roadcast.operators import queue as QU
from roadcast.operators.ranking import window_rank

COLS = ["event_id", "severity_tier", "road_closure_probability", "evidence_count", "confidence_label",
        "match_level", "officers_requested", "barricades_requested"]
BASE = [
    ("medium-well-evidenced", "Medium", 0.90, 40, "High confidence", "fine", 4, 1),
    ("high-rare", "High", 0.10, 2, "Low confidence — cause-only match", "cause_only", 6, 1),
    ("low-routine", "Low", 0.05, 22, "High confidence", "fine", 2, 0),
]
NEW_CAUSE = ("new-cause", "Unknown", None, 0, "Insufficient data — defer to officer judgment", "no_data", 3, 1)


def queue(spark, rows):
    data = [("q1", i + 1, "d", *r) for i, r in enumerate(rows)]
    schema = ("queue_id string, input_index long, description string, event_id string, severity_tier string, "
              "road_closure_probability double, evidence_count long, confidence_label string, match_level string, "
              "officers_requested int, barricades_requested int")
    return spark.createDataFrame(data, schema)


def run(spark, rows, officers, barricades):
    a = QU.allocate(queue(spark, rows), officers=officers, barricades=barricades)
    return sorted(a.collect(), key=lambda r: r["rank"])


@pytest.mark.parametrize("budget", [(20, 4), (8, 1), (3, 0), (0, 2)])
def test_budget_never_exceeded(spark, budget):
    rows = run(spark, BASE, *budget)
    assert sum(r["officers_allocated"] for r in rows) <= budget[0]
    assert sum(r["barricades_allocated"] for r in rows) <= budget[1]


def test_order_by_score(spark):
    rows = run(spark, BASE, 20, 4)
    assert [r["event_id"] for r in rows][:2] == ["high-rare", "medium-well-evidenced"]
    scores = [r["priority_score"] for r in rows]
    assert scores == sorted(scores, reverse=True)
    assert scores == [1.6175, 1.465, 0.6675]


def test_partial_grant(spark):
    rows = {r["event_id"]: r for r in run(spark, BASE, 7, 1)}
    hr, med, low = rows["high-rare"], rows["medium-well-evidenced"], rows["low-routine"]
    assert (hr["officers_allocated"], hr["barricades_allocated"], hr["covered"]) == (6, 1, True)
    assert (med["officers_allocated"], med["barricades_allocated"], med["covered"]) == (1, 0, False)
    assert "only 1 of 4 requested officers available" in med["risk_flag"]
    assert low["officers_allocated"] == 0


def test_zero_evidence_enters_queue(spark):
    rows = run(spark, BASE + [NEW_CAUSE], 20, 4)
    assert len(rows) == 4 and "new-cause" in [r["event_id"] for r in rows]
    assert [r for r in rows if r["event_id"] == "new-cause"][0]["priority_score"] == 0.3025


def test_totals_reconcile(spark):
    a = QU.allocate(queue(spark, BASE), officers=7, barricades=1)
    s = QU.summary(a).collect()[0]
    assert s["officers_allocated"] + s["officers_remaining"] == 7
    assert s["barricades_allocated"] + s["barricades_remaining"] == 1
    assert s["events_covered"] + s["events_at_risk"] == 3


def greedy(rows, officers, barricades):
    """The reference's loop, for comparison with the closed form."""
    out, ro, rb = {}, officers, barricades
    for r in rows:
        o, b = min(r["officers_requested"], ro), min(r["barricades_requested"], rb)
        ro, rb = ro - o, rb - b
        out[r["event_id"]] = (o, b)
    return out


def test_closed_form_equals_loop(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(f"e{i}", rnd.choice(["Low", "Medium", "High", "Unknown"]), rnd.choice([None, 0.1, 0.5, 0.9]),
             rnd.randint(0, 30), rnd.choice(["High confidence", "Moderate confidence"]), "fine",
             rnd.randint(0, 10), rnd.randint(0, 1)) for i in range(60)]
    for budget in [(0, 0), (25, 3), (100, 20)]:
        got = run(spark, rows, *budget)
        want = greedy(got, *budget)
        assert {r["event_id"]: (r["officers_allocated"], r["barricades_allocated"]) for r in got} == want
        with monkeypatch.context() as m:
            m.setattr(QU, "rank_rows", window_rank)
            single = run(spark, rows, *budget)
        assert [r["event_id"] for r in single] == [r["event_id"] for r in got]


def test_rejects_negative_counts(spark):
    bad = [("neg", "Low", 0.1, 3, "High confidence", "fine", -1, 0)]
    q = queue(spark, BASE + bad)
    assert [r["event_id"] for r in QU.queue_rejects(q).collect()] == ["neg"]
    assert len(QU.allocate(q, officers=10, barricades=2).collect()) == 3


def test_closure_score_nan_and_text(spark):
    df = spark.createDataFrame([("nan",), ("abc",), (None,), ("1.7",), ("-2",), ("0.3",)], "p string")
    got = [r[0] for r in df.select(QU.closure_score(F.col("p"))).collect()]
    assert got == [0.0, 0.0, 0.0, 1.0, 0.0, 0.3]


def test_missing_ids_and_descriptions_fall_back(spark):
    q = queue(spark, BASE).withColumns({
        "event_id": F.when(F.col("input_index") == 1, F.lit("")), "description": F.lit(""),
        "id": F.when(F.col("input_index") == 2, F.lit("own")), "label": F.when(F.col("input_index") < 3, F.lit("a label"))})
    got = {r["input_index"]: (r["event_id"], r["description"]) for r in QU.allocate(q).collect()}
    assert got == {1: ("a label", "a label"), 2: ("own", "a label"), 3: ("incident-3", "incident-3")}
