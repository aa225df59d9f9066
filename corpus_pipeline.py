"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents.

Every stage works on all rows that its predecessor kept:

1. toxicity: rows that the string-kernel classifier rejects go.
2. n-gram Jaccard join: of each group of near-duplicates the row with the smallest id stays.
3. secret scans: live secrets and copied examples in the texts are replaced by marks.
4. mixing: rows are repeated or left out so that each source comes near its target.
5. BPE: ids of the mixed texts and the texts they decode to, as counts and digests.

All stages but the last return the columns of documents. Nulls, empty texts, ties, repeated rows, empty tables and
further columns are handled as the operators' docstrings say.

Executors use the same Python workers for all stages, so what one stage made them take counts in the next ones too. Stages
whose Python steps get whole texts and are started by whoever writes their result set a smaller Arrow batch for the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcast.llm import jaccard_join, pareto_mix, queries, secret_scan, toxicity
from roadcast.llm.shared import ARROW_ROWS, WIDE_ROWS, cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: a model of the labelled documents that aren't held out, applied to all."""
    spark.conf.set(ARROW_ROWS, str(WIDE_ROWS))
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2."""
    return jaccard_join.first_of_groups(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3; n_chars follows the text."""
    out = secret_scan.redacted(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4."""
    return pareto_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: one row for each row of the mix."""
    spark.conf.set(ARROW_ROWS, str(WIDE_ROWS))
    return queries.encoded_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each),
    ("secret_scan", redact_secrets),
    ("pareto_mix", mix_sources),
    ("bpe", encode),
]

#: Trained models, keyed hashes of shingles and merge rounds have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
