"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging.

Queries are dealt into blocks and candidates into shards; every (block, shard)
tile is one matrix product in one task, which keeps only the k best of each
query. Partial top lists then meet in a tree: lists of up to ``FAN_IN`` shards
merge per step until one list per query is left, so no task ever sees more
than FAN_IN * k rows of a query.

Scores are exact: components are floor(64 * x) of x as a double; the product
runs in float64 where every partial sum of a pair is below 2**53, and in Python
integers for the other pairs; a score that 64 bits can't hold becomes the nearest long. Ties go to the smaller id.

Cases: rows with a null id, a null vector, or null or non-finite components
take no part; vectors of another length than the query's don't meet it; of
repeated ids as a query the smallest vector counts; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadcast.llm.shared import cut

QUERY_BLOCK, SHARD, FAN_IN = 2048, 8192, 16
SCALE = 64  # a power of two: doubles hold multiples of 1 / SCALE exactly


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, d, v): usable rows only, v the components floored to whole 1 / SCALE, as little-endian doubles, which hold them exactly."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, packed, dims = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)):
                if i is None or v is None:
                    continue
                x = np.asarray(v, dtype=np.float64)
                if np.isfinite(x).all():
                    x = np.where(np.abs(x) < 2.0**52, np.floor(SCALE * np.clip(x, -2.0**52, 2.0**52)) / SCALE, x)  # larger ones are whole
                    ids.append(i)
                    packed.append((x + 0.0).astype("<f8").tobytes())
                    dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["id", "d", "v"])
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(pack, "id long, d int, v binary")


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["v"]), dtype="<f8").reshape(len(frame), -1)


def _whole(row: np.ndarray) -> list[int]:
    """A row in 1 / SCALE as Python integers."""
    return [int(x) * SCALE if abs(x) >= 2.0**52 else int(x * SCALE) for x in row.tolist()]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def tile_scores(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query within one tile."""
    q, c = _matrix(queries), _matrix(shard)
    ids, qids = shard["id"].to_numpy(), queries["id"].to_numpy()
    out: list[tuple] = []
    with np.errstate(over="ignore", invalid="ignore"):  # what overflows is computed anew below
        a, b = q * SCALE, c.T * SCALE
        most_q, most_c = np.abs(a).max(axis=1, initial=0) * max(1, q.shape[1]), np.abs(b).max(axis=0, initial=0)
        for lo in range(0, len(q), 256):
            s = a[lo:lo + 256] @ b
            for k_row, (row, qid) in enumerate(zip(s, qids[lo:lo + 256]), lo):
                beyond = np.flatnonzero(~(most_q[k_row] * most_c < 2.0**53))  # sums that doubles may not hold
                row[beyond] = 0
                vals = row.astype(np.int64)
                if len(beyond):
                    own = _whole(q[k_row])
                    vals[beyond] = [min(max(sum(x * y for x, y in zip(own, _whole(c[j]))), -2**63), 2**63 - 1) for j in beyond]
                at = np.flatnonzero(ids != qid)
                best = _best(vals[at], ids[at], k)
                out.append((qid, ids[at][best], vals[at][best]))
    n = [len(x[1]) for x in out]
    return pd.DataFrame({"query_id": np.repeat(np.array([x[0] for x in out], dtype=np.int64), n),
                         "vec_id": np.concatenate([x[1] for x in out]) if out else np.array([], np.int64),
                         "score": np.concatenate([x[2] for x in out]) if out else np.array([], np.int64)})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of quantised ``queries`` against quantised ``candidates``."""
    candidates = cut(candidates, "topk-candidates")
    queries = cut(queries.groupBy("id", "d").agg(F.min("v").alias("v")), "topk-queries")
    shards = max(1, -(-candidates.count() // SHARD))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    q = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    c = candidates.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def tile(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = tile_scores(left, right, k) if len(left) and len(right) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return found.assign(part=np.int32(key[1]))

    keys = ("d", "shard", "block")
    parts = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(
        lambda key, left, right: tile(key, left, right), "query_id long, vec_id long, score long, part int")
    while shards > 1:
        shards = -(-shards // FAN_IN)
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        parts = _merged(parts, k).drop("rank")
    return _merged(parts, k).select("query_id", "rank", "vec_id", "score")


def _merged(parts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "part").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
