"""Plan properties: the forecast never shuffles the incoming side."""

import re

from roadcast.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_forecast_plan_has_only_broadcast_exchanges(spark):
    df = QUERIES["forecast_batch"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"(\w*Exchange)\b", plan)
    assert exchanges and set(exchanges) == {"BroadcastExchange"}
    assert plan.count("BroadcastHashJoin") == 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_date_range_reads_its_folders_only(spark, tmp_path):
    """Partition filters for a range, dynamic pruning for a table of dates, one file a date for a small log."""
    import os
    from pyspark.sql import functions as F
    from roadcast.plans import context as ctx
    from roadcast.sources import sinks
    path = str(tmp_path / "clean")
    clean = ctx.clean(spark, "/root/testdata/sf0.001")
    sinks.write_clean(clean, path)
    days = sorted(d[0] for d in spark.read.parquet(path).select("start_date").distinct().collect() if d[0])
    some = sinks.read_clean(spark, path, days[1].isoformat(), days[3].isoformat())
    assert f"PartitionFilters: [isnotnull(start_date" in plan(some)
    assert len(some.select(F.input_file_name()).distinct().collect()) == 3
    assert some.count() == clean.where(F.to_date("start_datetime_ist").between(days[1], days[3])).count()
    dates = spark.createDataFrame([(days[0],), (days[0],)], "start_date date")
    one = sinks.read_clean(spark, path, dates=dates.where("start_date > '1970-01-01'"))
    assert "dynamicpruning" in plan(one)
    assert one.count() == clean.where(F.to_date("start_datetime_ist") == days[0]).count()
    assert all(len([f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")]) == 1 for d in os.listdir(path) if d.startswith("start_date="))


def test_feedback_lines_are_parsed_in_one_scan_without_python(spark, tmp_path):
    from roadcast.sources import feedback_files as FF
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.csv").write_text(FF.OLD_HEADER + '\n2024-05-01 10:00:00,"a ""b"", c",Unknown,45,true\n\n'
                                '2024-05-02 10:00:00,2024-05-02 09:00:00,x,"M, G",1,no,High,o,verified\nshort\n')
    (path / "b.csv").write_text("timestamp, extra ,corridor\n2024-05-03 10:00:00,?,R,more\n")
    (path / "c.csv").write_text("2024-05-04 10:00:00,2024-05-04 09:00:00,y,Z,2,yes,Low,,disputed\n")
    rows = FF.read_feedback_text(spark, str(path))
    text = plan(rows)
    assert text.count("FileScan text") == 1 and "Python" not in text and "MapIn" not in text
    got = {r["timestamp"]: r.asDict() for r in rows.collect()}
    assert len(got) == 5
    old, new = got["2024-05-01 10:00:00"], got["2024-05-02 10:00:00"]
    assert (old["event_datetime"], old["actual_duration_minutes"], old["actual_requires_road_closure"], old["verification_status"]) == (
        "2024-05-01 10:00:00", "45", "true", None)
    assert (new["event_datetime"], new["corridor"], new["actual_requires_road_closure"]) == ("2024-05-02 09:00:00", "M, G", "no")
    assert got["2024-05-03 10:00:00"]["corridor"] == "R" and got["short"]["corridor"] is None
    assert got["2024-05-04 10:00:00"]["verification_status"] == "disputed"
