"""Incident replay and verified-outcome streams (ST1-ST5).

Batch forms (ST1, ST3, ST4) are plain DataFrame jobs. The stream forms use
Structured Streaming with ``trigger(availableNow=True)`` over a file source
and ``foreachBatch``:

* ST2 - each micro-batch of incidents is forecast against the baseline
  (stream-static broadcast joins), appended to a sink table, and folded
  into a rolling "latest 8" table written as a new version per batch;
* ST5 - each micro-batch of feedback is keyed, checked against the stored
  log (``left_anti``), appended, and the groups it touches are recomputed
  from value counts into a new baseline version, which the next batch reads.

All state lives in files under the session's checkpoint directory (the
cluster's shared folder), so a restarted query resumes from its own
streaming checkpoint.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcast.operators import baseline as BL
from roadcast.operators import deploy as DP
from roadcast.operators import feedback as FB
from roadcast.operators import forecast as FC
from roadcast.operators.match import Baselines, prepare_baselines
from roadcast.session import ensure_checkpoint_dir
from roadcast.operators.sizing import materialize
from roadcast.sources.sinks import append_feedback, children
from roadcast.sources.store import BaselineStore

REPLAY_COUNT = 15
FEED_SIZE = 8
REPLAY_COLUMNS = ["incident_id", "planned_start", "event_cause", "corridor", "match_level", "severity_tier",
                  "recommended_personnel_count", "barricade_recommended"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:10]}")


# --- batch forms ----------------------------------------------------------------

def replay_source(clean: DataFrame, n: int = REPLAY_COUNT) -> DataFrame:
    """Newest ``n`` incidents (TakeOrdered), as forecast requests."""
    newest = clean.where(F.col("start_datetime_ist").isNotNull()) \
        .orderBy(F.col("start_datetime_ist").desc(), F.col("id").desc()).limit(n)
    return newest.select(
        F.col("id").alias("incident_id"), F.col("start_datetime_ist").alias("planned_start"), "event_cause",
        F.when(F.col("corridor") == "Non-corridor", F.lit(None).cast("string")).otherwise(F.col("corridor"))
        .alias("corridor"),
        F.coalesce(F.col("requires_road_closure"), F.lit(False)).alias("requires_road_closure"))


def score_incidents(incoming: DataFrame, base: Baselines) -> DataFrame:
    return DP.recommend(FC.forecast(incoming, base), with_text=False).select(*REPLAY_COLUMNS)


def replay_batch(clean: DataFrame, n: int = REPLAY_COUNT) -> DataFrame:
    """ST1: newest ``n`` incidents, oldest first, through forecast + recommendation."""
    scored = score_incidents(replay_source(clean, n), prepare_baselines(clean))
    from pyspark.sql import Window
    w = Window.orderBy(F.col("planned_start").asc(), F.col("incident_id").asc())  # n rows at most
    return scored.withColumn("replay_order", F.row_number().over(w))


def latest(scored: DataFrame, k: int = FEED_SIZE) -> DataFrame:
    """ST3: the ``k`` newest scored incidents."""
    return scored.orderBy(F.col("planned_start").desc(), F.col("incident_id").desc()).limit(k)


def replay_gaps(replayed: DataFrame) -> DataFrame:
    """ST4: hours since the previous replayed incident (never negative)."""
    from pyspark.sql import Window
    w = Window.orderBy("replay_order")  # the replay holds at most REPLAY_COUNT rows
    prev = F.lag("planned_start").over(w)
    secs = F.unix_micros(F.col("planned_start").cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    return replayed.select("replay_order", "incident_id", "planned_start",
                           F.greatest(F.lit(0.0), secs.cast("double") / F.lit(3.6e9)).alias("gap_hours"))


# --- ST2: replay as a stream ------------------------------------------------------------

def write_stream_source(df: DataFrame, path: str, day_col: str) -> None:
    """Land rows as files, one folder per day (the stream's input)."""
    df.withColumn("_day", F.to_date(F.col(day_col))).write.mode("overwrite").partitionBy("_day").parquet(path)


def replay_stream(spark: SparkSession, incoming: DataFrame, clean: DataFrame,
                  files_per_trigger: int = 8, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the replay as a Structured Streaming query; returns (scored, latest-8).

    ``folder`` holds source, sink, feed versions and the query's checkpoint; called again with it, the query goes on
    where it stopped. All state is what is stored there.
    """
    base = prepare_baselines(clean)
    folder = folder or scratch(spark, "replay")
    src, sink, feed, ckpt = (os.path.join(folder, p) for p in ("source", "sink", "feed", "checkpoint"))
    if "_SUCCESS" not in children(spark, src):
        write_stream_source(incoming, src, "planned_start")
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        # one sink folder and one feed version per micro-batch: a batch that runs again reads what came before
        # it and overwrites only its own
        part = os.path.join(sink, f"batch={batch_id}")
        score_incidents(batch.drop("_day"), base).write.mode("overwrite").parquet(part)
        merged = spark.read.parquet(part)
        earlier = [v for v in children(spark, feed) if v < f"v{batch_id:06d}"]
        if earlier:
            merged = spark.read.parquet(os.path.join(feed, earlier[-1])).unionByName(merged)
        latest(merged).write.mode("overwrite").parquet(os.path.join(feed, f"v{batch_id:06d}"))

    q = (stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    scored = spark.read.parquet(sink).drop("batch")
    versions = children(spark, feed)
    last = spark.read.parquet(os.path.join(feed, versions[-1])) if versions else scored.limit(0)
    return scored, last


# --- ST5: verified outcomes as a stream -----------------------------------------------

def feedback_stream(spark: SparkSession, log: DataFrame, clean: DataFrame,
                    files_per_trigger: int = 8, folder: str | None = None) -> DataFrame:
    """Fold a feedback stream into versioned baselines; returns the last version. ``folder``: as in :func:`replay_stream`."""
    folder = folder or scratch(spark, "feedback")
    src, log_dir, base_dir, ckpt = (os.path.join(folder, p) for p in ("source", "log", "baselines", "checkpoint"))
    if "_SUCCESS" not in children(spark, src):
        write_stream_source(log, src, "event_datetime")
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    store = BaselineStore(spark, base_dir)
    if not store.numbers():
        counts = materialize(BL.value_counts(clean), "value-counts")
        store.publish(BL.grains_of(counts), counts, note="initial")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        # a log folder and a version per micro-batch: a batch that runs again replaces its own log folder, and publishes
        # only if it hadn't yet; it reads its own rows and the counts of the causes that they touch
        before = store.read()
        if store.manifest(before.number)["note"] == f"batch {batch_id}":
            return
        added = append_feedback(spark, batch.drop("_day"), log_dir, str(batch_id))
        grains, counts = FB.refresh_baseline(before.grains, before.state, FB.feedback_events(added))
        store.publish(grains, counts, before, f"batch {batch_id}")

    q = (stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return store.read().grains
