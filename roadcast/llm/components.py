"""Connected components of links between documents or vectors.

Alternating large-star and small-star steps on an edge table, each written to
the shared folder. Edges are first contracted within each partition (a
union-find over the partition's own edges), which leaves at most one edge per
node and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcast.llm.shared import cut


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) and the smallest node each one reaches, by repeated minima over the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[low]
        if np.array_equal(new, low):
            return nodes, nodes[low]
        low = new


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, dtype=np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy()])
            b = np.concatenate([b, batch.column(1).to_numpy()])
            a, b = roots(a, b)
            keep = a != b
            a, b = a[keep], b[keep]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])
    return edges.mapInArrow(run, "u long, v long")


def _stars(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (two long columns, no nulls); component is its smallest node."""
    a, b = edges.columns[:2]
    flat = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    state = cut(_contracted(flat).distinct(), "edges")
    before = None
    while True:
        # large star: a node's larger neighbours meet the least of all its neighbours and itself
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = cut(_stars(both.where("v > u"), least).distinct(), "edges")
        # small star: a node and its smaller neighbours meet the least of these
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        own = least.select("u", F.col("m").alias("v"))
        state = cut(_stars(large, least).unionByName(own).distinct(), "edges")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return cut(found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct(), "components")
