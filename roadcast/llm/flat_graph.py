"""Near-duplicate vectors by a robust-pruned flat graph.

1. Vectors that are equal as unit vectors become one node with a number of
   copies, so a vector that a third of all rows hold costs one node.
2. Nodes are dealt to the shards of their OVERLAP nearest centroids (spherical
   k-means on a bounded sample of SAMPLE rows; every node is indexed). A shard
   of more than PART nodes is split at random into parts; its queries visit
   every part, so no link is lost by the split.
3. Each part builds a graph: for each node the CLOSE nearest and RANDOM other
   nodes are robust-pruned to DEGREE neighbours, and edges are returned.
4. The adjacency lists of a node from all its shards are united.
5. Every node is a query in each of its shards: greedy search from the part's
   medoids with a beam of BEAM, then the range expands: all visited nodes at or
   near the threshold are expanded until none is left.
6. Visited pairs are verified by cosine in double precision. A pair is counted
   in the first shard that both have, and a pair that only a later shard's search
   found is added to that, so each counts once. Tasks return a spanning forest of
   all their links and, per query, the number of links and the ids of those whose
   nodes share several shards (large shards: in portions by the ids' hash).
7. Recall is audited by distinct links, whatever their copies: AUDIT nodes,
   chosen by a hash, are compared with all nodes by brute force, and four times
   as many until AUDIT_LINKS links are seen, all nodes were asked or MOST_AUDIT
   were. If links are rarer than that, as many nodes that the search found linked
   are asked too. While recall is below RECALL, another centroid is added to the
   overlap, up to MOST_OVERLAP; then overlap and beam double, until every node is
   in all shards and every search visits its whole part, which is exact.

Cases: null, zero, and vectors with null or non-finite components, and rows
with a null id, link with nothing; vectors of different length don't link;
repeated rows are copies of each other; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcast.llm.components import components, roots
from roadcast.llm.shared import cut

OVERLAP, MOST_OVERLAP, SHARD, PART, QUERIES = 2, 5, 1500, 2048, 2048
SAMPLE, MOST_SHARDS, ITERATIONS = 8192, 1024, 8
CLOSE, RANDOM, DEGREE, ALPHA = 32, 8, 16, 1.2
BEAM, EXPAND, SLACK, MEDOIDS = 24, 4, 0.05, 3
AUDIT, MOST_AUDIT, AUDIT_LINKS, RECALL = 64, 4096, 400, 0.98


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, d, unit): unit vectors as little-endian doubles; null for rows that link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, units = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)):
                x = None if v is None or i is None else np.asarray(v, dtype=np.float64)
                if x is None or not len(x) or not np.isfinite(x).all() or not np.abs(x).max() > 0:
                    dims.append(None)
                    units.append(None)
                    continue
                x = x / np.abs(x).max()
                dims.append(len(x))
                units.append((x / np.sqrt((x * x).sum()) + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "d", "unit"])
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(run, "vec_id long, d int, unit binary")


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype="<f8").reshape(len(units), -1)


def centroids(nodes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, from the SAMPLE nodes that come first by a hash of their id."""
    rows = nodes.select("d", "unit").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    out: dict[int, np.ndarray] = {}
    for d in sorted({r["d"] for r in rows}):
        x = _matrix([bytes(r["unit"]) for r in rows if r["d"] == d])
        k = min(len(x), MOST_SHARDS, max(1, round(count * len(x) / len(rows) / SHARD)))
        c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(ITERATIONS):
            at = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
        out[d] = c
    return out


def assigned(nodes: DataFrame, centres: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """``nodes`` with ``shards``: "d:k" of the nearest centroids, ascending; "d" alone where the sample had no vector of length d."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("d").to_numpy()
            lists: list[list[str]] = [[] for _ in dims]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                c = shared.value.get(int(d))
                if c is None:
                    for i in at:
                        lists[i] = [f"{d}"]
                    continue
                near = np.argsort(-(_matrix([b.column("unit")[int(i)].as_py() for i in at]) @ c.T), axis=1, kind="stable")[:, :overlap]
                for i, ks in zip(at, near):
                    lists[i] = sorted(f"{d}:{k}" for k in ks)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.string()))], [*b.schema.names, "shards"])
    return nodes.mapInArrow(run, "rep long, copies long, d int, unit binary, shards array<string>")


def robust_graph(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Neighbours of each row of the unit matrix ``x``: robust-pruned candidates and the edges back to them."""
    n = len(x)
    if n <= DEGREE + 1:
        return [np.delete(np.arange(n), i) for i in range(n)]
    rng = np.random.default_rng(seed)
    close = min(CLOSE, n - 1)
    out: list[list[int]] = [[] for _ in range(n)]
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(n, lo + 256))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-sims, close - 1, axis=1)[:, :close]
        cand = np.c_[near, rng.integers(0, n, (len(rows), RANDOM))]
        own = np.take_along_axis(sims, cand, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, axis=1), np.take_along_axis(own, order, axis=1)
        far = np.sqrt(np.maximum(2 - 2 * np.maximum(own, -1), 0))
        v = x[cand]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("ijd,ikd->ijk", v, v), 0))
        alive = np.isfinite(own)
        for _ in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            r = np.flatnonzero(some)
            for i in r:
                out[rows[i]].append(int(cand[i, first[i]]))
            # a candidate that a chosen neighbour is ALPHA times closer to is left to that neighbour
            covered = ALPHA * between[np.arange(len(rows)), first] <= far
            alive &= ~covered
            alive[r, first[r]] = False
    back: list[list[int]] = [[] for _ in range(n)]
    for i, js in enumerate(out):
        for j in js:
            if len(back[j]) < 2 * DEGREE:
                back[j].append(i)
    return [np.unique(np.array(a + b, dtype=np.int64)) for a, b in zip(out, back)]


def _entries(x: np.ndarray, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Medoids of random groups, and a further entry for whatever can't be reached from them."""
    mean = x.mean(axis=0)
    entries = [int((x @ mean).argmax())]
    for some in np.array_split(rng.permutation(len(x)), MEDOIDS - 1):
        if len(some):
            entries.append(int(some[(x[some] @ x[some].mean(axis=0)).argmax()]))
    reached = np.zeros(len(x) + 1, dtype=bool)
    reached[-1] = True
    front = np.unique(entries)
    reached[front] = True
    while True:
        while len(front):
            new = np.unique(table[front])
            front = new[~reached[new]]
            reached[front] = True
        left = np.flatnonzero(~reached[:-1])
        if not len(left):
            return np.unique(entries)
        front = left[:1]
        entries.append(int(front[0]))
        reached[front] = True


def range_search(x: np.ndarray, neighbours: list[np.ndarray], queries: np.ndarray, threshold: float, seed: int = 0, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of visited rows at or above the threshold."""
    n = len(x)
    width = max(1, max((len(a) for a in neighbours), default=1))
    table = np.full((n, width), n, dtype=np.int64)  # n: none
    for i, a in enumerate(neighbours):
        table[i, :len(a)] = a
    entries = _entries(x, table, np.random.default_rng(seed))
    found: list[tuple] = []
    for lo in range(0, len(queries), 256):
        q = queries[lo:lo + 256]
        m = len(q)
        sims = np.full((m, n + 1), -2.0)
        opened = np.zeros((m, n + 1), dtype=bool)
        opened[:, n] = True

        def visit(rows: np.ndarray, nodes: np.ndarray) -> None:
            fresh = (nodes < n) & (sims[rows, np.minimum(nodes, n)] < -1.5)
            key = np.unique(rows[fresh] * (n + 1) + nodes[fresh])
            rows, nodes = key // (n + 1), key % (n + 1)
            for at in range(0, len(key), 1 << 16):
                r, v = rows[at:at + (1 << 16)], nodes[at:at + (1 << 16)]
                sims[r, v] = np.einsum("ij,ij->i", q[r], x[v])

        visit(np.repeat(np.arange(m), len(entries)), np.tile(entries, m))
        live = np.arange(m)
        width_of_beam = min(beam, n)
        while len(live):
            own = sims[live]
            worst = -np.partition(-own, width_of_beam - 1, axis=1)[:, width_of_beam - 1]
            ready = np.where(opened[live] | (own < np.maximum(worst, -1.5)[:, None]), -3.0, own)
            take = min(EXPAND, n)
            best = np.argpartition(-ready, take - 1, axis=1)[:, :take]
            good = np.take_along_axis(ready, best, axis=1) > -1.5
            going = good.any(axis=1)
            r = np.repeat(live, take)[good.ravel()]
            v = best.ravel()[good.ravel()]
            opened[r, v] = True
            visit(np.repeat(r, width), table[v].ravel())
            live = live[going]
        while True:  # the range expands
            r, v = np.nonzero((sims >= threshold - SLACK) & ~opened)
            if not len(r):
                break
            opened[r, v] = True
            for at in range(0, len(r), 1 << 14):
                visit(np.repeat(r[at:at + (1 << 14)], width), table[v[at:at + (1 << 14)]].ravel())
        r, v = np.nonzero(sims[:, :n] >= threshold)
        found.append((r + lo, v, sims[r, v]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _links(nodes: DataFrame, threshold: float, overlap: int, centres: dict[int, np.ndarray], beam: int = BEAM) -> DataFrame:
    """(rep, other, n, pairs): rows with other = rep hold numbers of links, with copies and without, the others a spanning forest of links."""
    nodes = cut(assigned(nodes, centres, overlap), "graph-nodes")
    each = nodes.withColumn("shard", F.explode("shards"))
    sizes = {r["shard"]: r["n"] for r in each.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_SHARDS rows a vector length
    n_parts = {s: 1 << (-(-n // PART) - 1).bit_length() for s, n in sizes.items()}
    most = max(n_parts.values(), default=1)  # powers of two: a portion of the ids is within one part of the largest shards
    parts = F.create_map(*[F.lit(x) for s, n in sorted(n_parts.items()) for x in (s, n)]) if sizes else F.create_map(F.lit(""), F.lit(1))
    blocks = F.create_map(*[F.lit(x) for s, n in sorted(sizes.items()) for x in (s, -(-n // QUERIES))]) if sizes else F.create_map(F.lit(""), F.lit(1))
    members = each.withColumn("part", F.pmod(F.xxhash64("rep"), F.element_at(parts, F.col("shard"))).cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        ids = frame["rep"].to_numpy()
        lists = robust_graph(_matrix(frame["unit"].tolist()), len(ids))
        return pd.DataFrame({"rep": ids, "near": [ids[a] for a in lists]})

    lists = members.select("shard", "part", "rep", "unit").groupBy("shard", "part").applyInPandas(build, "rep long, near array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    full = members.join(cut(united, "graph-lists"), "rep").withColumn("portion", F.pmod(F.xxhash64("rep"), F.lit(most)).cast("int"))
    full = full.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("shard")) - 1)))
    asked = each.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.element_at(blocks, F.col("shard"))).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("shard")) - 1)))

    def search(key: tuple, queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(index):
            return pd.DataFrame({c: pd.Series([], dtype="int64" if c not in ("own", "more") else object) for c in ("rep", "other", "n", "pairs", "portion", "own", "more")})
        index, queries = index.sort_values("rep"), queries.sort_values("rep")
        ids, x = index["rep"].to_numpy(), _matrix(index["unit"].tolist())
        asked_ids = queries["rep"].to_numpy()
        lists = []
        for near in index["near"]:
            at = np.searchsorted(ids, near)
            at = at[at < len(ids)]
            lists.append(at[np.isin(ids[at], near)])
        q, v, _ = range_search(x, lists, _matrix(queries["unit"].tolist()), threshold, len(ids), beam)
        keep = asked_ids[q] != ids[v]
        q, v = q[keep], v[keep]
        # a pair counts in the first shard that both are in; what other shards find is compared with that
        theirs, mine = index["shards"].tolist(), queries["shards"].tolist()
        shared = [set(mine[a]).intersection(theirs[b]) for a, b in zip(q, v)]
        first = np.array([min(k) == key[0] for k in shared], dtype=bool)
        several = np.array([len(k) > 1 for k in shared], dtype=bool)
        some, at = np.unique(q * most + index["portion"].to_numpy()[v], return_inverse=True)
        pairs = np.bincount(at, weights=first, minlength=len(some)).astype(np.int64)
        n = np.bincount(at, weights=index["copies"].to_numpy()[v] * first, minlength=len(some)).astype(np.int64)

        def others(which: np.ndarray) -> list[np.ndarray]:
            held = ids[v[which]][np.argsort(at[which], kind="stable")]
            return np.split(held, np.cumsum(np.bincount(at[which], minlength=len(some)))[:-1]) if len(some) else []

        node, root = roots(asked_ids[q], ids[v]) if len(q) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        tree = node != root
        asking, none, zero = asked_ids[some // most], [[]] * int(tree.sum()), np.zeros(int(tree.sum()), dtype=np.int64)
        return pd.DataFrame({"rep": np.r_[asking, node[tree]], "other": np.r_[asking, root[tree]], "n": np.r_[n, zero], "pairs": np.r_[pairs, zero],
                             "portion": np.r_[some % most, zero], "own": pd.Series(others(first & several) + none, dtype=object),
                             "more": pd.Series(others(~first) + none, dtype=object)})

    keys = ("shard", "part", "block")
    left = asked.select(*(F.col(c).alias(c) for c in (*keys, "rep", "unit", "shards"))).groupBy(*keys)  # columns of their own
    right = full.select(*keys, "rep", "unit", "shards", "copies", "near", "portion").groupBy(*keys)
    found = cut(left.cogroup(right).applyInPandas(lambda key, a, b: search(key, a, b), "rep long, other long, n long, pairs long, portion long, own array<long>, more array<long>"), "graph-found")
    return cut(_counted(found, nodes), "graph-links")


def _counted(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rep, other, n, pairs) of what the shards' searches found, each pair counted once whichever shards found it."""
    asking = found.where("rep = other").groupBy("rep", "portion").agg(
        F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("more")).alias("more"))
    asking = cut(asking.select("rep", "n", "pairs", F.array_except("more", "own").alias("missed")), "graph-counts")
    missed = asking.select("rep", F.explode("missed").alias("other")).join(nodes.select(F.col("rep").alias("other"), "copies"), "other")
    return found.where("rep <> other").select("rep", "other", "n", "pairs").unionByName(
        asking.select("rep", F.col("rep").alias("other"), "n", "pairs")).unionByName(
        missed.select("rep", F.col("rep").alias("other"), F.col("copies").alias("n"), F.lit(1).cast("long").alias("pairs")))


def _true_links(nodes: DataFrame, asked: list, threshold: float) -> dict[int, int]:
    """Numbers of other nodes that link with each node of ``asked`` that has any, by brute force over all nodes."""
    dims = {d: [r for r in asked if r["d"] == d] for d in {r["d"] for r in asked}}
    shared = nodes.sparkSession.sparkContext.broadcast({d: (np.array([r["rep"] for r in rs]), _matrix([bytes(r["unit"]) for r in rs])) for d, rs in dims.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(reps), dtype=np.int64) for d, (reps, _) in shared.value.items()}
        for b in batches:
            ids, dims = (b.column(c).to_numpy() for c in ("rep", "d"))
            for d, (reps, q) in shared.value.items():
                every = np.flatnonzero(dims == d)
                for lo in range(0, len(every), 1024):
                    at = every[lo:lo + 1024]
                    x = _matrix([b.column("unit")[int(i)].as_py() for i in at])
                    total[d] += ((x @ q.T >= threshold) & (ids[at][:, None] != reps)).sum(axis=0)
        some = [(int(rep), int(n)) for d, (reps, _) in shared.value.items() for rep, n in zip(reps, total[d]) if n]
        yield pa.RecordBatch.from_arrays([pa.array([rep for rep, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], ["rep", "n"])

    found = nodes.select("rep", "d", "unit").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    return {r["rep"]: r["n"] for r in found.collect()}


def audited_recall(nodes: DataFrame, links: DataFrame, threshold: float) -> float:
    """Share of the distinct links of the asked nodes, found by brute force over all nodes, that ``links`` counts."""
    def first(rows: DataFrame, count: int) -> list:
        return rows.orderBy(F.xxhash64("rep", F.lit(11)), "rep").limit(count).select("rep", "d", "unit").collect()

    counted = links.where("rep = other").groupBy("rep").agg(F.sum("pairs").alias("pairs"))
    count = AUDIT
    while True:
        asked = first(nodes, count)
        true = _true_links(nodes, asked, threshold) if asked else {}
        if sum(true.values()) >= AUDIT_LINKS or len(asked) < count or count >= MOST_AUDIT:
            break
        count *= 4
    if sum(true.values()) < AUDIT_LINKS and len(asked) == count:  # links are rare: nodes that have some
        more = first(nodes.join(counted.where("pairs > 0").select("rep"), "rep", "left_semi"), MOST_AUDIT)
        true |= _true_links(nodes, more, threshold) if more else {}
    if not true:
        return 1.0
    got = {r["rep"]: r["pairs"] for r in counted.where(F.col("rep").isin(list(true))).collect()}
    return sum(min(got.get(k, 0), n) for k, n in true.items()) / sum(true.values())


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row; recall is the audited one of the whole run."""
    units = cut(unit_vectors(rows, id_col, vec_col).withColumn("key", F.md5("unit")), "graph-units")
    nodes = cut(units.where("unit IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("d").alias("d"), F.first("unit").alias("unit")), "graph-distinct")
    plain = nodes.select("rep", "copies", "d", "unit")
    centres = centroids(plain, plain.count())
    overlap, beam, shards = OVERLAP, BEAM, max(map(len, centres.values()), default=1)
    while True:
        links = _links(plain, threshold, overlap, centres, beam)
        recall = audited_recall(plain, links, threshold)
        if recall >= RECALL:
            break
        if overlap >= shards and beam >= 2 * PART:
            raise RuntimeError(f"recall of {recall} although all shards were searched whole")
        if overlap < MOST_OVERLAP:
            overlap += 1
        else:
            overlap, beam = 2 * overlap, 2 * beam
    counts = links.where("rep = other").groupBy("rep").agg(F.sum("n").alias("linked"))
    group = components(links.where("rep <> other").select("rep", "other"))
    result = nodes.select("key", "rep", "copies").join(counts, "rep", "left").join(group, F.col("rep") == F.col("node"), "left")
    result = cut(result.select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                               F.coalesce("component", "rep").alias("component_id")), "graph-result")
    out = units.select("vec_id", "key").join(result, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("recall", F.lit(recall))
