"""Stream results equal batch results; mixed-layout feedback text is recovered."""

import datetime as dt

from pyspark.sql import functions as F

from roadcast.operators import baseline as BL
from roadcast.operators import feedback as FB
from roadcast.operators.match import prepare_baselines
from roadcast.plans import context as ctx
from roadcast.sources import feedback_files as FF
from roadcast.streaming import ordered as OR
from roadcast.streaming import replay as RP

SF = "/root/testdata/sf0.001"


def rows(df, cols):
    return sorted(tuple(str(x) for x in r) for r in df.select(*cols).collect())


def test_replay_stream_equals_batch(spark):
    clean, inc = ctx.clean(spark, SF), ctx.incoming(spark, SF)
    streamed, latest = RP.replay_stream(spark, inc, clean)
    batch = RP.score_incidents(inc, prepare_baselines(clean))
    assert rows(streamed, RP.REPLAY_COLUMNS) == rows(batch, RP.REPLAY_COLUMNS)
    assert rows(latest, RP.REPLAY_COLUMNS) == rows(RP.latest(batch), RP.REPLAY_COLUMNS)


INCIDENTS = [(k, f"2024-03-{1 + k % 3:02d} 0{k % 7}:{k % 60:02d}:00") for k in range(1, 90)] + [(500, "2024-03-02 03:10:00")] * 2 + [(7, None)]


def incidents(spark, rows):
    return spark.createDataFrame(rows, "incident_id long, at string").select("incident_id", F.col("at").cast("timestamp_ntz").alias("planned_start"))


def test_ordered_replay_of_shuffled_arrival_equals_batch(spark, tmp_path):
    inc = incidents(spark, INCIDENTS)
    got = OR.in_time_order(inc, OR.ordered_times(spark, inc, str(tmp_path / "a"), files_per_trigger=5)).collect()
    rows = sorted((r["planned_start"], r["incident_id"]) for r in got)
    assert len(rows) == 91
    for r in got:
        before = sum(t < r["planned_start"] for t, _ in rows)
        assert r["earlier"] == before
    gaps = sorted((r["planned_start"], r["incident_id"], -r["gap_hours"], r["gap_hours"]) for r in got)
    for (t0, *_), (t, i, _, gap) in zip(gaps, gaps[1:]):
        assert gap == (t - t0).total_seconds() / 3600 or (i == 500 and t.minute == 10)
    assert OR.late_rows(spark, str(tmp_path / "a")).count() == 0
    assert OR.ordered_times(spark, incidents(spark, []), str(tmp_path / "b")).count() == 0


def test_rows_behind_the_watermark_are_listed(spark, tmp_path):
    folder = str(tmp_path / "late")
    OR.land(incidents(spark, [(1, "2024-03-05 10:00:00"), (2, "2024-03-05 10:30:00")]), f"{folder}/source", files=1)
    OR._run(spark, folder, 600, 1)
    incidents(spark, [(3, "2024-03-05 08:00:00"), (4, "2024-03-05 10:25:00")]).select(
        "incident_id", F.col("planned_start").cast("timestamp").alias("planned_start")).coalesce(1).write.mode("append").parquet(f"{folder}/source")
    times = OR.ordered_times(spark, None, folder, delay=600).orderBy("planned_start").collect()
    assert [(r["first_id"], r["earlier"]) for r in times] == [(1, 0), (4, 1), (2, 2)]
    assert [r["planned_start"].hour for r in OR.late_rows(spark, folder).collect()] == [8]


def test_feedback_stream_equals_batch_refresh(spark):
    clean, log = ctx.clean(spark, SF), ctx.feedback(spark, SF)
    streamed = RP.feedback_stream(spark, log, clean)
    batch = BL.all_grains(FB.combined_history(clean, FB.feedback_events(log)))
    cols = sorted(batch.columns)
    assert rows(streamed, cols) == rows(batch, cols)


def test_mixed_layout_text(spark, tmp_path):
    new = spark.createDataFrame(
        [(dt.datetime(2024, 5, 1, 10), dt.datetime(2024, 5, 1, 8, 30), "public_event", "MG Road", "120", "true",
          "High", "officer-1", "verified")],
        "timestamp timestamp, event_datetime timestamp, event_cause string, corridor string, "
        "actual_duration_minutes string, actual_requires_road_closure string, priority string, "
        "verified_by string, verification_status string")
    path = str(tmp_path / "mixed")
    FF.write_with_header(new, path, FF.OLD_HEADER)
    old_file = tmp_path / "old.csv"
    old_file.write_text(FF.OLD_HEADER + "\n2024-05-01 10:00:00,public_event,Unknown,45,true\n")
    spark.read.text(str(old_file)).write.mode("append").text(path)
    got = FB.normalise(FF.read_feedback_text(spark, path)).orderBy("actual_duration_minutes").collect()
    assert [(r["corridor"], r["actual_duration_minutes"], r["verification_status"]) for r in got] == [
        ("Non-corridor", 45.0, "unverified"), ("MG Road", 120.0, "verified")]
