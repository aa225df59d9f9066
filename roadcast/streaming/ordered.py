"""Replay in time order by event-time state (ST2, ST4): whatever order the incidents arrive in.

A row's place among all incidents and the gap before it need only the distinct start times. The stream keeps them as
keyed state: per stretch of BUCKET seconds the times met so far, each with its number of incidents and its smallest id.
When the watermark has passed a stretch, its timer gives the times in order and the state goes. What a stretch doesn't
know, the last time and the number of incidents before it, comes from one row a stretch when the result is read, summed
within days and then over days.

* ``delay`` is the disorder that the watermark allows. Left out, it is the time span of the source, so no row is late in
  a replay of stored incidents. Rows later than it are not ordered; :func:`late_rows` lists them.
* A replay ends with a marker row, after which all stretches are settled. State, sink and source lie in ``folder``; a
  query that was stopped goes on from there, and the end is itself such a restart.
* State of a stretch is bounded by its distinct microseconds, not by its rows: any number of incidents may share a time.

Cases: rows without a start time have no place and are left out; repeated rows count each; an empty source gives an
empty result.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadcast.sources.sinks import children

BUCKET = 900
DAY_US = 86_400_000_000
SOURCE = "incident_id long, planned_start timestamp"
TIMES = "bucket long, t long, previous long, n long, first_id long, earlier long"
STATE = "t array<long>, n array<long>, first_id array<long>"


def land(incoming: DataFrame, path: str, files: int = 16) -> None:
    """Start times and ids as ``files`` files or more, each from all over the time range: an arrival out of order."""
    rows = incoming.where("planned_start IS NOT NULL").select("incident_id", F.col("planned_start").cast("timestamp").alias("planned_start"))
    rows.repartition(files, F.xxhash64("incident_id")).write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).parquet(path)


def _held(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds a stretch's new rows to its state, or gives its times in order when its timer fires."""
    t, n, first = (np.array(c, dtype=np.int64) for c in (state.get if state.exists else ([], [], [])))
    if state.hasTimedOut:
        state.remove()
        previous = pd.array(np.r_[0, t[:-1]], dtype="Int64")
        previous[0] = pd.NA
        yield pd.DataFrame({"bucket": int(key[0]), "t": t, "previous": previous, "n": n, "first_id": first, "earlier": np.cumsum(n) - n})
        return
    for f in frames:
        t, n = np.r_[t, f["t"].to_numpy()], np.r_[n, np.ones(len(f), dtype=np.int64)]
        first = np.r_[first, f["incident_id"].to_numpy(dtype=np.int64)]
        order = np.lexsort((first, t))
        t, n, first = t[order], n[order], first[order]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        t, n, first = t[starts], np.add.reduceat(n, starts), first[starts]
    state.update((t.tolist(), n.tolist(), first.tolist()))
    state.setTimeoutTimestamp((int(key[0]) + 1) * BUCKET * 1000)


def _run(spark: SparkSession, folder: str, delay: int, files_per_trigger: int) -> None:
    rows = (spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files_per_trigger).parquet(os.path.join(folder, "source"))
            .withWatermark("planned_start", f"{delay} seconds"))
    rows = rows.select("incident_id", "planned_start", F.unix_micros("planned_start").alias("t"),
                       F.floor(F.unix_micros("planned_start") / (BUCKET * 1_000_000)).alias("bucket"))
    times = rows.groupBy("bucket").applyInPandasWithState(_held, TIMES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    query = (times.writeStream.format("parquet").option("path", os.path.join(folder, "times"))
             .option("checkpointLocation", os.path.join(folder, "checkpoint")).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def ordered_times(spark: SparkSession, incoming: DataFrame, folder: str, delay: int | None = None,
                  files_per_trigger: int = 4) -> DataFrame:
    """(planned_start, previous, n, first_id, earlier) per distinct start time: the time before it, its incidents, the
    smallest id, and the number of incidents at earlier times."""
    source = os.path.join(folder, "source")
    if "_SUCCESS" not in children(spark, source):
        land(incoming, source)
    ended = os.path.join(folder, "ended")
    if "_SUCCESS" not in children(spark, ended):
        first, last = spark.read.schema(SOURCE).parquet(source).where("incident_id IS NOT NULL").agg(F.min("planned_start"), F.max("planned_start")).first()
        if last is None:
            return _placed(spark.createDataFrame([], TIMES))
        wait = delay if delay is not None else int((last - first).total_seconds()) + 1
        _run(spark, folder, wait, files_per_trigger)
        marker = [(None, last + dt.timedelta(seconds=wait + 2 * BUCKET))]
        spark.createDataFrame(marker, SOURCE).coalesce(1).write.mode("append").parquet(source)
        _run(spark, folder, wait, files_per_trigger)
        spark.createDataFrame([(wait,)], "delay long").coalesce(1).write.mode("overwrite").parquet(ended)
    return _placed(spark.read.schema(TIMES).parquet(os.path.join(folder, "times")))


def _placed(times: DataFrame) -> DataFrame:
    """Times with what came before their stretch: one row a stretch, summed within a day and over days."""
    day = F.floor(F.col("bucket") * (BUCKET * 1_000_000) / DAY_US)
    stretches = times.groupBy("bucket").agg(F.sum("n").alias("_n"), F.max("t").alias("_last")).withColumn("_day", day)
    days = stretches.groupBy("_day").agg(F.sum("_n").alias("_n"), F.max("_last").alias("_last"))
    past_days = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.select("_day", F.sum("_n").over(past_days).alias("_day_n"), F.max("_last").over(past_days).alias("_day_last"))
    past = Window.partitionBy("_day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = stretches.select("bucket", "_day", F.sum("_n").over(past).alias("_in_n"), F.max("_last").over(past).alias("_in_last"))
    before = before.join(days, "_day").select("bucket", (F.coalesce("_in_n", F.lit(0)) + F.coalesce("_day_n", F.lit(0))).alias("_before"),
                                              F.coalesce("_in_last", "_day_last").alias("_last"))
    return times.join(before, "bucket").select(
        F.timestamp_micros("t").alias("planned_start"), F.timestamp_micros(F.coalesce("previous", "_last")).alias("previous"),
        "n", "first_id", (F.col("earlier") + F.col("_before")).alias("earlier"))


def in_time_order(scored: DataFrame, times: DataFrame) -> DataFrame:
    """``scored`` with ``earlier``, the number of incidents that start before, and ``gap_hours`` since the previous incident
    (incidents of one time follow each other by id; the first of all has 0)."""
    at = times.select(F.col("planned_start").alias("_at"), "previous", "first_id", "earlier")
    start = F.col("planned_start").cast("timestamp")
    gap = F.greatest(F.lit(0.0), (F.unix_micros(F.col("_at")) - F.unix_micros("previous")).cast("double") / F.lit(3.6e9))
    return scored.join(at, start == F.col("_at")).select(
        *scored.columns, "earlier", F.when(F.col("incident_id") == F.col("first_id"), gap).otherwise(F.lit(0.0)).alias("gap_hours"))


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(planned_start, arrived, ordered): times of which the watermark refused incidents, with how many came and were ordered."""
    came = spark.read.schema(SOURCE).parquet(os.path.join(folder, "source")).where("incident_id IS NOT NULL")
    came = came.groupBy("planned_start").agg(F.count(F.lit(1)).alias("arrived"))
    times = spark.read.schema(TIMES).parquet(os.path.join(folder, "times"))
    done = times.groupBy(F.timestamp_micros("t").alias("planned_start")).agg(F.sum("n").alias("ordered"))
    both = came.join(done, "planned_start", "left").select("planned_start", "arrived", F.coalesce("ordered", F.lit(0)).alias("ordered"))
    return both.where("ordered < arrived")
