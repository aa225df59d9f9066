"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: the sources, ordered by code point
with null last, weigh 5, 2, 1, 5, 2, 1, ... and share all words of the corpus
by weight; a target stops at ``MAX_COPIES`` times its source's words, and the
excess goes to the others by weight until no target is above its limit.

A target of f times its source's words takes floor(f) certain whole copies of
every document. The rest of the target is an unequal-probability sample without
replacement: document i has an inclusion probability pi_i that falls with its
length (so that few very long documents don't fill the rest), its inclusion
odds are pi_i / (1 - pi_i), its random odds u_i / (1 - u_i) with u_i from the
document's id, and documents are taken in ascending order of random odds over
inclusion odds until the words of the rest are reached. The sample's size is
thus fixed in words, to within half a document.

The order statistic is found without sorting a source in one task: two levels
of 256 bins of the ranking variable (sums per source and bin, at most 256 rows
a source) leave 1/65,536 of a source's rows for the only window.

Cases: null text has size 0; rows of size 0 take nothing; repeated rows share
a rank and are cut in any order, as they are equal; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadcast.llm.shared import SPACED_WORD, cut, packed, unpacked

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 256
SCALE = 10_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, docs, target) of each source of rows (key, size); key null sorts last.

    Water filling in closed form: with the sources ordered by limit over
    weight, the limited ones are a prefix of that order.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("long"))
    src = src.withColumn("lim", MAX_COPIES * F.col("source_size"))
    order = Window.orderBy(F.col("lim").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("lim").over(before), F.lit(0))
    src = src.withColumn("level", left.cast("double") / F.sum("weight").over(onward)).withColumn("n", F.row_number().over(order))
    free = F.col("level") * F.col("weight") < F.col("lim")
    src = src.withColumn("first_free", F.min(F.when(free, F.col("n"))).over(every))
    src = src.withColumn("share", F.max(F.when(F.col("n") == F.col("first_free"), F.col("level"))).over(every))
    limited = F.col("first_free").isNull() | (F.col("n") < F.col("first_free"))
    return src.select("source", "source_size", "docs", F.when(limited, F.col("lim").cast("double")).otherwise(
        F.col("share") * F.col("weight")).alias("target"))


def _key(column: str = "source"):
    """A join key that keeps null apart from every name."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("null"))


def _boundary(rows: DataFrame, level: str, before) -> DataFrame:
    """Per source key: the bin in which the rest is reached and the words before it."""
    bins = rows.groupBy("key", level).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first(before).alias("start"))
    w = Window.partitionBy("key").orderBy(level)
    bins = bins.withColumn("upto", F.col("start") + F.sum("words").over(w)).where(F.col("upto") >= F.col("rest"))
    return bins.groupBy("key").agg(F.min(level).alias(f"at_{level}"), F.min_by(F.col("upto") - F.col("words"), level).alias(f"sum_{level}"))


def _sized(docs: DataFrame, *keep: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    return docs.select(*map(F.col, keep), F.struct(F.col("doc_id").alias("doc_id"), words.alias("size"), _key().alias("key")).alias("_mix"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, size, key, the source's columns) with the Pareto ranking variable x and its cell."""
    rows = rows.withColumn("h", _length_weight())
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("long")
    rows = rows.withColumn("u", (digits + F.lit(0.5)) / F.lit(float(1 << 48)))
    rows = rows.withColumn("pi", F.when(F.col("weighed") > 0, F.col("rest") * F.col("h") / F.col("weighed")).otherwise(0.0))
    # q = random odds over inclusion odds, x = q / (1 + q) in [0, 1]; 0 for a certain document
    num, den = F.col("u") * (1 - F.col("pi")), (1 - F.col("u")) * F.col("pi")
    rows = rows.withColumn("x", F.when(F.col("pi") >= 1, 0.0).otherwise(num / (num + den)))
    return rows.withColumn("cell", F.least(F.floor(F.col("x") * BINS * BINS), F.lit(BINS * BINS - 1)).cast("long"))


def _length_weight():
    return F.expr(f"({SCALE} * greatest(source_size div docs, 1)) div (greatest(source_size div docs, 1) + size)")


def thresholds(docs: DataFrame) -> DataFrame:
    """One row per source: its target, certain copies and the rank up to which documents get one copy more."""
    words = cut(_sized(docs, "source").select("source", "_mix.*"), "mix-sizes")
    src = cut(source_targets(words).withColumn("key", _key()).drop("source"), "mix-sources")
    weighed = words.join(src, "key").groupBy("key").agg(F.sum(F.col("size") * _length_weight()).alias("weighed"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    src = src.join(weighed, "key").withColumn("copies", copies)
    src = cut(src.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-rest")
    rows = _ranked(words.drop("source").join(src, "key")).where((F.col("size") > 0) & (F.col("rest") > 0))
    rows = cut(rows.select("key", "doc_id", "size", "rest", "x", "cell", F.expr(f"cell div {BINS}").alias("b1"),
                           (F.col("cell") % BINS).alias("b2")), "mix-ranked")
    one = cut(_boundary(rows, "b1", F.lit(0).cast("long")), "mix-bins")
    inside = rows.join(one, "key").where(F.col("b1") == F.col("at_b1"))
    two = cut(one.join(_boundary(inside, "b2", F.col("sum_b1")), "key"), "mix-bins")
    edge = rows.join(two, "key").where((F.col("b1") == F.col("at_b1")) & (F.col("b2") == F.col("at_b2")))
    w = Window.partitionBy("key").orderBy("x", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("sum_b2") + F.coalesce(F.sum("size").over(w), F.lit(0))
    edge = edge.withColumn("ahead", ahead).where(2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest"))
    last = edge.groupBy("key").agg(F.max(F.struct("x", "doc_id")).alias("last"))
    two = two.select("key", (F.col("at_b1") * BINS + F.col("at_b2")).alias("at")).join(last, "key", "left")
    return cut(src.join(two, "key", "left"), "mix-thresholds")


def _decided(rows: DataFrame, limits: DataFrame) -> DataFrame:
    rows = _ranked(rows.join(limits, "key"))
    within = F.coalesce((F.col("cell") == F.col("at")) & (F.struct("x", "doc_id") <= F.col("last")), F.lit(False))
    extra = (F.col("rest") > 0) & (F.col("size") > 0) & (F.col("at").isNull() | (F.col("cell") < F.col("at")) | within)
    return rows.withColumn("taken_copies", F.col("copies") + extra.cast("long"))


def sampled(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source, ...)."""
    rows = _decided(_sized(docs).select("_mix.*"), thresholds(docs))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("taken_copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (not at all where it takes none); texts aren't shuffled."""
    rows = packed(docs)
    rows = _sized(rows.select("_row", "_row.doc_id", "_row.text", "_row.source"), "_row").select("_row", "_mix.*")
    rows = _decided(rows, thresholds(docs)).where("taken_copies > 0")
    return unpacked(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "taken_copies"))))
