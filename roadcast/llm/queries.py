"""The registered jobs opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcast.llm import bpe, decontamination, flat_graph, jaccard_join, k2_treap, legacy_archive, license_scan, pareto_mix, prefix_trie, secret_scan, topk, toxicity, wrapper
from roadcast.llm.oracles import ORACLES
from roadcast.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["ORACLES", "QUERIES"]


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC and back."""
    return legacy_archive.round_trip(table(spark, sf_dir, "pages")).drop("uri", "date")


@_query
def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrapper.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Ids of every text and the text they decode to, as counts and digests."""
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.coded(docs, path)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@_query
def op3_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return encoded_digests(table(spark, sf_dir, "documents"))


@_query
def op5_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@_query
def op7_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, further shapes by ownership."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@_query
def op8_topk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every 20th vector."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.col("id") % 20 == 0), vectors, 20)


@_query
def op9_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets."""
    return pareto_mix.sampled(table(spark, sf_dir, "documents"))


@_query
def op4_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors."""
    return flat_graph.near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


@_query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


@_query
def op11_k2_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return k2_treap.search_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
