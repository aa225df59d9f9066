"""Verified-outcome refresh cases restated over DataFrames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadcast.operators import baseline as BL
from roadcast.operators import feedback as FB

LOG_SCHEMA = ("log_seq long, timestamp timestamp, event_datetime timestamp, event_cause string, corridor string, "
              "actual_duration_minutes string, actual_requires_road_closure string, priority string, "
              "verified_by string, verification_status string")


@pytest.fixture(scope="module")
def clean(spark):
    rows = []
    for i, d in enumerate([60.0, 70.0, 70.0, 70.0, 80.0]):
        s = dt.datetime(2024, 4, 1 + i, 8, 0)
        rows.append((str(i + 1), "planned", "public_event", "MG Road", "High", False, s, s, d, True, 8, s.weekday(),
                     False, "morning"))
    schema = ("id string, event_type string, event_cause string, corridor string, priority string, "
              "requires_road_closure boolean, start_datetime timestamp, start_datetime_ist timestamp, "
              "duration_minutes double, has_duration boolean, hour_of_day int, day_of_week int, is_weekend boolean, "
              "hour_bucket string")
    return spark.createDataFrame(rows, schema)


def base_row(seq=1, logged=dt.datetime(2024, 5, 1, 10, 0), duration="120", status="verified"):
    return (seq, logged, dt.datetime(2024, 5, 1, 8, 30), "public_event", "MG Road", duration, "true", "High",
            "officer-1", status)


def fine_row(spark, clean, log_rows):
    log = spark.createDataFrame(log_rows, LOG_SCHEMA)
    ev = FB.feedback_events(log)
    grains = BL.all_grains(FB.combined_history(clean, ev))
    r = BL.fine_baseline(grains).where(
        (F.col("corridor") == "MG Road") & (F.col("event_cause") == "public_event")
        & (F.col("is_weekend") == False) & (F.col("hour_bucket") == "morning")).collect()  # noqa: E712
    return r[0]


def test_verified_outcome_updates_counts(spark, clean):
    r = fine_row(spark, clean, [base_row()])
    assert (r["event_count"], r["duration_count"], r["road_closure_rate"]) == (6, 6, round(1 / 6, 4))


def test_duplicate_counted_once(spark, clean):
    r = fine_row(spark, clean, [base_row(1), base_row(2, logged=dt.datetime(2024, 5, 1, 11, 0))])
    assert (r["event_count"], r["duration_count"]) == (6, 6)


def test_bad_duration_only_leaves_duration_stats(spark, clean):
    r = fine_row(spark, clean, [base_row(duration="not-a-number")])
    assert (r["event_count"], r["duration_count"], r["median_duration_minutes"]) == (6, 5, 70.0)


def test_unverified_excluded(spark, clean):
    r = fine_row(spark, clean, [base_row(status="unverified")])
    assert (r["event_count"], r["duration_count"], r["road_closure_rate"]) == (5, 5, 0.0)


def test_old_layout(spark):
    old = spark.createDataFrame([("2024-05-01 10:00:00", "public_event", "Unknown", "45", "true")],
                                "timestamp string, event_cause string, corridor string, "
                                "actual_duration_minutes string, requires_road_closure string")
    r = FB.normalise(old).collect()[0]
    assert r["corridor"] == "Non-corridor"
    assert r["actual_requires_road_closure"] is True
    assert r["verification_status"] == "unverified"
    assert r["event_datetime"] == dt.datetime(2024, 5, 1, 10, 0)


def test_resubmission_refused(spark):
    first = spark.createDataFrame([base_row(1)], LOG_SCHEMA)
    again = spark.createDataFrame([base_row(2, logged=dt.datetime(2024, 5, 2, 9, 0))], LOG_SCHEMA)
    assert FB.accept(first).count() == 1
    assert FB.accept(again, existing=first).count() == 0
    sub = FB.submissions(first.unionByName(again)).orderBy("log_seq").collect()
    assert [r["accepted"] for r in sub] == [True, False]


def test_incremental_refresh_equals_full(spark, clean):
    log = spark.createDataFrame([base_row(1), base_row(2, duration="15")], LOG_SCHEMA)
    ev = FB.feedback_events(log)
    inc, _ = FB.refresh_baseline(BL.all_grains(clean), BL.value_counts(clean), ev)
    full = BL.all_grains(FB.combined_history(clean, ev))
    cols = sorted(full.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, inc.select(cols).collect()), key=key) == \
        sorted(map(tuple, full.select(cols).collect()), key=key)
