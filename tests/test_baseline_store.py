"""Baselines in two passes against plain statistics; stored versions and refreshes without the history."""

import random
import statistics
import threading
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roadcast.operators import baseline as BL
from roadcast.operators import feedback as FB
from roadcast.plans import context as ctx
from roadcast.sources.store import BaselineStore

SF = "/root/testdata/sf0.001"
CLEAN = ("id long, corridor string, event_cause string, is_weekend boolean, hour_bucket string, requires_road_closure boolean, "
         "priority string, has_duration boolean, duration_minutes double")


def incidents(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        d = rng.choice([None, 0.0, 7.25, 7.5, 7.75, 8.0, rng.uniform(0, 20), rng.uniform(0, 2000)])
        rows.append((rng.choice([i, i, None]), rng.choice(["c1", "c2", None]), rng.choice(["x", "x", "x", "y", "", None]), rng.choice([True, False, None]),
                     rng.choice(["night", "evening"]), rng.choice([True, False, None]), rng.choice(["High", "Low", None]), d is not None, d))
    return rows


def plain(rows):
    out = {}
    for grain, keys in BL.GRAINS.items():
        groups = defaultdict(list)
        for r in rows:
            row = dict(zip([c.split()[0] for c in CLEAN.split(", ")], r))
            own = tuple(row[k] for k in keys)
            if None not in own and row["event_cause"] is not None:
                groups[own].append(row)
        for own, rs in groups.items():
            durations = [r["duration_minutes"] for r in rs if r["has_duration"]]
            modes = Counter(r["priority"] for r in rs if r["priority"])
            mode = min(modes, key=lambda p: (-modes[p], p)) if modes else "Unknown"
            key = (grain, *(dict(zip(keys, own)).get(k) for k in BL.KEYS))
            count = len(durations) if durations or grain == "cause" else None
            out[key] = (sum(r["id"] is not None for r in rs), mode, count, statistics.median(durations) if durations else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_two_passes_equal_plain_statistics(spark, seed):
    rows = incidents(seed)
    got = {(r.grain, r.corridor, r.event_cause, r.is_weekend, r.hour_bucket): (r.event_count, r.priority_mode, r.duration_count, r.median_duration_minutes)
           for r in BL.all_grains(spark.createDataFrame(rows, CLEAN).repartition(3)).collect()}
    expected = plain(rows)
    assert got.keys() == expected.keys()
    for k, (n, mode, count, median) in expected.items():
        assert got[k][:3] == (n, mode, count)
        assert (got[k][3] is None) == (median is None) and (median is None or abs(got[k][3] - median) <= 0.0051)


def test_passes_scan_once_without_expand(spark):
    clean = ctx.clean(spark, SF)
    source = BL.counted_rows(clean)
    first = BL.minute_histogram(source)._jdf.queryExecution().executedPlan().toString()
    targets = BL._targets(BL._groups(BL.minute_histogram(source), "cause"))
    from roadcast.operators.sizing import materialize
    second = BL.target_values(source, materialize(targets), ("fine", "coarse", "cause"))._jdf.queryExecution().executedPlan().toString()
    for plan in (first, second):
        assert "Expand" not in plan and plan.count("events.parquet") == 1


def state_of(spark, rows):
    return BL.value_counts(spark.createDataFrame(rows, CLEAN))


def test_refresh_adds_counts_and_reads_no_history(spark, tmp_path):
    store, rows, more = BaselineStore(spark, f"file://{tmp_path}"), incidents(3), incidents(4, 40)
    counts = state_of(spark, rows)
    assert store.publish(BL.grains_of(counts), counts) == 1
    old = store.read()
    grains, delta = FB.refresh_baseline(old.grains, old.state, spark.createDataFrame(more, CLEAN))
    plan = grains._jdf.queryExecution().toString()
    assert "events.parquet" not in plan
    assert store.publish(grains, delta, old) == 2
    full = BL.all_grains(spark.createDataFrame(rows + more, CLEAN))
    cols = sorted(full.columns)
    got, expected = ({tuple(map(str, r)) for r in df.select(cols).collect()} for df in (store.read().grains, full))
    assert got == expected
    assert {tuple(map(str, r)) for r in BL.add_counts(store.read().state).collect()} == {tuple(map(str, r)) for r in state_of(spark, rows + more).collect()}


def test_state_with_many_parts_is_summed(spark, tmp_path, monkeypatch):
    from roadcast.sources import store as S
    monkeypatch.setattr(S, "MOST_PARTS", 2)
    store, every = BaselineStore(spark, f"file://{tmp_path}"), []
    version = None
    for k in range(4):
        every += incidents(10 + k, 30)
        counts = state_of(spark, incidents(10 + k, 30))
        store.publish(BL.grains_of(counts).limit(1), counts, version)
        version = store.read()
    assert store.expire(1) == [1, 2, 3]
    assert {tuple(map(str, r)) for r in BL.add_counts(store.read().state).collect()} == {tuple(map(str, r)) for r in state_of(spark, every).collect()}


def test_two_writers_and_a_pinned_reader(spark, tmp_path):
    store = BaselineStore(spark, f"file://{tmp_path}")
    with pytest.raises(LookupError):
        store.read()
    a, b = state_of(spark, incidents(5, 60)).cache(), state_of(spark, incidents(6, 60)).cache()
    store.publish(BL.grains_of(a), a, note="first")
    pinned = store.read()
    before = pinned.grains.count()
    numbers = []
    writers = [threading.Thread(target=lambda s=s: numbers.append(BaselineStore(spark, f"file://{tmp_path}").publish(BL.grains_of(s), s))) for s in (a, b)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(numbers) == [2, 3] and store.numbers() == [1, 2, 3]
    assert pinned.number == 1 and pinned.grains.count() == before and store.read().number == 3
    assert store._named(3, {"folder": "x"}) is False and store.manifest(1)["note"] == "first"
    assert store.expire(2) == [1] and store.numbers() == [2, 3]
    assert store.read(2).grains.count() > 0


def test_forecasts_read_the_stored_version(spark):
    from roadcast.plans import QUERIES
    plan = QUERIES["forecast_batch"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "/baselines-" in plan and plan.count("events.parquet") == 1  # the incoming side only


def test_an_unwritten_manifest_is_no_version(spark, tmp_path):
    spark.range(1).select(F.lit("x").alias("value")).write.text(f"file://{tmp_path}/data-half")
    assert BaselineStore(spark, f"file://{tmp_path}").numbers() == []
