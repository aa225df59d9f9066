"""N-gram Jaccard self-join by rare-first prefix filtering.

A document's set is its distinct shingles of NGRAM words (64-bit hashes); two
documents link when |x & y| / |x | y| >= PERCENT / 100, as integers.

1. One scan gives each row its set's size, a 128-bit fingerprint and its prefix:
   the first n - ceil(t n) + 1 shingles in the global order, rare ones first.
   The order comes from counts of all shingles of the corpus in 2**20 hashed
   cells (a table of fixed size, summed over all tasks and broadcast); ties go
   by hash. Any common order is exact; a good one keeps postings short.
2. Documents with equal sets (copies) become one node, so a group of exact
   copies costs one row however large it is.
3. Prefix shingles meet in postings. In a posting of up to SMALL documents all
   pairs that pass the length and positional filters are candidates. In a
   larger one each document is a candidate with one pivot, the posting's first.
4. Candidates are made distinct, so that each pair is verified once, on whole
   sets. A suffix filter comes before: the shingles of a set are dealt to CELLS
   cells, and the differences of two sets' cell counts add up to no more than
   their symmetric difference.
5. In large postings, documents that are in one component after that need no
   further comparison. Documents of different components are compared in
   blocks by the three filters, which emit only what passes them, and these are
   verified likewise. So a large group of near copies is neither expanded into
   its pairs nor is a link lost.
6. Components of all links give the result.

Words are runs without the white space of the pattern [^\\x20\\x09-\\x0D]+ after
lowering A-Z, taken from UTF-8 bytes in numpy for a portion of texts at once.

Cases: null and empty texts and texts of white space have an empty set and link with nothing;
texts of fewer words than NGRAM have their whole word sequence as one shingle;
rows with a null id link with nothing and have a null component; rows that
share an id are one document; an empty table gives an empty result; further
columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcast.llm.components import components
from roadcast.llm.shared import NARROW_ROWS, WIDE_ROWS, arrow_rows, cut, packed, unpacked

NGRAM, PERCENT = 3, 90
RARITY_BITS, CHUNK = 20, 4096
SMALL, BLOCK, CELLS = 24, 512, 256
#: Bytes of text hashed at once; numpy holds many times as much meanwhile.
PORTION = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.array([pow(int(_BASE), -1, 1 << 64)], dtype=np.uint64)[0]
        size = max(n, PORTION + (PORTION >> 1))
        one = np.ones(1, dtype=np.uint64)
        _POWERS[:] = [np.cumprod(np.r_[one, np.full(size, b, dtype=np.uint64)]) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[bytes], ngram: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text."""
    joined = b"\n".join(texts).lower()
    raw = np.frombuffer(joined, dtype=np.uint8)
    if not len(raw):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers(len(raw) + 1)
    sums = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)])]
    words = _mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(lengths + 1)  # of each text with its separator
    cuts = np.searchsorted(start, ends)
    first = np.r_[0, cuts[:-1]]
    odd = np.array([((2 * k + 1) * int(_M2) + k) % (1 << 64) for k in range(ngram)], dtype=np.uint64)
    n = len(words) - ngram + 1
    rolled = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(ngram):
        rolled += words[k:k + max(n, 0)] * odd[k]
    rolled = _mixed(rolled + np.uint64(ngram))
    out = []
    for a, b in zip(first.tolist(), cuts.tolist()):
        if b - a >= ngram:
            out.append(np.unique(rolled[a:b - ngram + 1]))
        elif b > a:
            whole = (words[a:b] * odd[:b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mixed(whole + np.full(1, b - a, dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _portions(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of portions of bounded size; one text is never split."""
    at, some, size = 0, [], 0
    for i, x in enumerate(column.cast(pa.binary())):
        some.append(x.as_py() or b"")
        size += len(some[-1])
        if size >= PORTION:
            yield at, some
            at, some, size = i + 1, [], 0
    if some:
        yield at, some


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set: two sums of differently mixed members, and their number."""
    one, two = _mixed(s + _M1).sum(dtype=np.uint64), _mixed(s ^ _M2).sum(dtype=np.uint64)
    return np.array([one, two], dtype="<u8").tobytes()


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def rarity(docs: DataFrame) -> np.ndarray:
    """For each of 2**RARITY_BITS cells: the bit length of its shingles' number in the whole corpus, a table of fixed size."""
    cells = 1 << RARITY_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for b in batches:
            for _, texts in _portions(b.column(0)):
                some = [s for s in shingle_sets(texts) if len(s)]
                if some:
                    total += np.bincount((np.concatenate(some) >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=cells)
        if total.any():
            rows = total.astype("<i8").reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["chunk", "counts"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, dtype=np.int64)
        for c in frame["counts"]:
            total += np.frombuffer(c, dtype="<i8")
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "counts": [total.tobytes()]})

    schema = "chunk int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).withColumn("part", F.spark_partition_id() % 64)
    parts = parts.groupBy("chunk", "part").applyInPandas(added, schema).groupBy("chunk").applyInPandas(added, schema)
    out = np.zeros(cells, dtype=np.uint8)
    for r in parts.collect():
        counts = np.frombuffer(bytes(r["counts"]), dtype="<i8")
        # four steps to each doubling
        out[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.floor(4 * np.log2(counts + 1.0)).astype(np.uint8)
    return out


def shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sid, prefix, cells) of every row; prefix in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            for at, texts in _portions(b.column(1)):
                ns, sids, prefixes, cells = [], [], [], []
                for s in shingle_sets(texts):
                    p = prefix_length(len(s))
                    ns.append(len(s))
                    sids.append(fingerprint(s) if len(s) else None)
                    kept = b""
                    if p:
                        rank = table[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
                        kept = s[np.argsort(rank, kind="stable")[:p]].astype("<u8").tobytes()
                    prefixes.append(kept)
                    cells.append(cell_counts(s).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(ns, pa.int64()), pa.array(sids, pa.binary()),
                                                  pa.array(prefixes, pa.binary()), pa.array(cells, pa.binary())], ["doc_id", "n", "sid", "prefix", "cells"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sid binary, prefix binary, cells binary")


def _postings(nodes: DataFrame) -> DataFrame:
    """(token, rep, n, pos, held): prefix shingles that two or more nodes have."""
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.slice(lo, 2000)
                tokens = [np.frombuffer(x.as_py(), dtype="<i8") for x in part.column("prefix")]
                sizes = np.array([len(t) for t in tokens])
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(np.repeat(part.column("rep").to_numpy(), sizes)),
                     pa.array(np.repeat(part.column("n").to_numpy(), sizes).astype(np.int32)), pa.array(pos.astype(np.int32))], ["token", "rep", "n", "pos"])

    rows = nodes.select("rep", "n", "prefix").mapInArrow(flat, "token long, rep long, n int, pos int")
    return _repeated(rows)


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose token occurs again, by one exchange and a streaming pass over sorted partitions, which keeps one row in mind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, not given yet, and whether it repeats the one before
        same = False
        for b in batches:
            if not len(b):
                continue
            cols = [b.column(k).to_numpy() for k in range(4)]
            if held is not None:
                cols = [np.r_[h, c] for h, c in zip(held, cols)]
            t = cols[0]
            equal = t[1:] == t[:-1]
            keep = np.r_[same, equal] | np.r_[equal, False]
            out = [c[:-1][keep[:-1]] for c in cols]
            held, same = [c[-1:] for c in cols], bool(keep[-1])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["token", "rep", "n", "pos"])
        if held is not None and same:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["token", "rep", "n", "pos"])

    return rows.repartition("token").sortWithinPartitions("token", "n", "rep").mapInArrow(run, "token long, rep long, n int, pos int")


def _close_sizes(a: str, b: str):
    return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")


def _enough_left(an: str, apos: str, bn: str, bpos: str):
    """Positional filter: what is left from a common shingle on must reach the overlap that the sizes ask for."""
    return F.expr(f"({100 + PERCENT}) * least({an} - {apos}, {bn} - {bpos}) >= {PERCENT} * ({an} + {bn})")


def _small_pairs(postings: DataFrame) -> DataFrame:
    lists = postings.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rep", "n", "pos"))).alias("p"))
    pairs = lists.select(F.explode("p").alias("a"), "p").select("a", F.explode("p").alias("b")).where("a.rep < b.rep")
    pairs = pairs.where(_close_sizes("a.n", "b.n") & _enough_left("a.n", "a.pos", "b.n", "b.pos"))
    return pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def _star_pairs(postings: DataFrame) -> DataFrame:
    """Every document of a posting with the posting's first."""
    first = cut(postings.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("p")), "pivots")
    pairs = postings.select("token", "rep", "n").join(first, "token").where((F.col("rep") > F.col("p.rep")) & _close_sizes("n", "p.n"))
    return pairs.select(F.col("p.rep").alias("a"), F.col("rep").alias("b"))


def cell_counts(s: np.ndarray) -> np.ndarray:
    """Members per cell, at most 255: differences of these are no larger than those of the numbers."""
    return np.minimum(np.bincount((s % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8)


def _node_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, members) of the wanted nodes (rep, sid), from their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _portions(b.column(1)):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array([fingerprint(s) for s in sets], pa.binary()),
                     pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["rep", "sid", "members"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.select("rep").distinct(), "rep")
    found = texts.select("rep", "text").mapInArrow(run, "rep long, sid binary, members binary")
    return found.join(wanted, ["rep", "sid"], "left_semi").select("rep", "members")


def _differ_too_much(an: np.ndarray, bn: np.ndarray, difference: np.ndarray) -> np.ndarray:
    """Whether a symmetric difference of at least ``difference`` rules out the threshold: (100 + p) d > (100 - p) (n + m)."""
    return (100 + PERCENT) * difference.astype(np.int64) > (100 - PERCENT) * (an.astype(np.int64) + bn.astype(np.int64))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: suffix filter, then the whole sets, which only the pairs left need."""
    light = nodes.select("rep", F.col("n").cast("int").alias("n"), "cells")
    ab = pairs.join(light.toDF("a", "an", "ac"), "a").join(light.toDF("b", "bn", "bc"), "b")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 20_000):
                part = b.slice(lo, 20_000)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("ac", "bc"))
                keep = ~_differ_too_much(part.column("an").to_numpy(), part.column("bn").to_numpy(), np.abs(x - y).sum(axis=1))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    with arrow_rows(docs.sparkSession, WIDE_ROWS):
        left = cut(ab.mapInArrow(filtered, "a long, b long"), "candidates")
    wanted = left.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = cut(nodes.select("rep", "sid").join(wanted, "rep"), "wanted")
    with arrow_rows(docs.sparkSession, WIDE_ROWS):
        members = cut(_node_sets(docs, wanted), "sets")
    both = left.join(members.toDF("a", "am"), "a").join(members.toDF("b", "bm"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("am"), b.column("bm")):
                x, y = np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with arrow_rows(docs.sparkSession, WIDE_ROWS):
        return cut(both.mapInArrow(verify, "a long, b long"), "links")


def _across(postings: DataFrame, nodes: DataFrame, group: DataFrame) -> DataFrame:
    """Candidates between documents of different components in the same large posting."""
    rows = postings.join(nodes.select("rep", "n", "cells"), ["rep", "n"]).join(group.toDF("rep", "component"), "rep", "left")
    rows = cut(rows.withColumn("component", F.coalesce("component", "rep")), "large-postings")
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo < hi")
    mixed = cut(mixed.select("token", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")), "mixed-postings")
    rows = rows.join(mixed, "token").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["own"] == key[1]].sort_values("rep"), frame[frame["own"] == key[2]].sort_values("rep")
        x, y = (np.frombuffer(b"".join(f["cells"]), dtype=np.uint8).reshape(-1, CELLS).astype(np.int16) for f in (left, right))
        rep, n, pos, comp = (right[c].to_numpy() for c in ("rep", "n", "pos", "component"))
        out_a, out_b = [], []
        for c, r, m, p, k in zip(x, left["rep"], left["n"], left["pos"], left["component"]):
            at = np.flatnonzero((comp != k) & (rep > r if key[1] == key[2] else rep != r) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
                                & ((100 + PERCENT) * np.minimum(n - pos, m - p) >= PERCENT * (n + m)))
            if len(at):
                at = at[~_differ_too_much(n[at], np.full(len(at), m), np.abs(y[at] - c).sum(axis=1))]
                out_a += [min(r, o) for o in rep[at]]
                out_b += [max(r, o) for o in rep[at]]
        return pd.DataFrame({"a": np.array(out_a, dtype=np.int64), "b": np.array(out_b, dtype=np.int64)})

    return rows.groupBy("token", "i", "j").applyInPandas(lambda key, frame: compare(key, frame), "a long, b long")


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    with arrow_rows(spark, WIDE_ROWS):
        rows = cut(shingled(docs), "shingled")
    usable = rows.where("n > 0 AND doc_id IS NOT NULL")
    first = F.min_by(F.struct("prefix", "cells"), "doc_id")
    nodes = cut(usable.groupBy("sid", "n").agg(F.min("doc_id").alias("rep"), first.alias("f")).select("sid", "n", "rep", "f.*"), "set-nodes")
    with arrow_rows(spark, NARROW_ROWS):
        postings = cut(_postings(nodes), "postings")
    held = postings.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    large_tokens = cut(held.where(F.col("held") > SMALL).select("token"), "large-tokens")
    large = cut(postings.join(large_tokens, "token"), "large")
    small = postings.join(large_tokens, "token", "left_anti")
    pairs = cut(_small_pairs(small).unionByName(_star_pairs(large)).distinct(), "pairs")
    links = _verified(pairs, nodes, docs)
    more = cut(_across(large, nodes, components(links)).distinct(), "pairs")
    links = links.unionByName(_verified(more, nodes, docs)).distinct()
    # rows that share an id are one document even if their texts differ
    shared_ids = nodes.join(rows.select("sid", F.col("doc_id").alias("other")).distinct(), "sid").where("other <> rep").select(
        F.col("rep").alias("a"), F.col("other").alias("b")).join(_several_texts(usable).withColumnRenamed("doc_id", "b"), "b").select("a", "b")
    group = components(links.unionByName(shared_ids))
    result = cut(nodes.select("sid", "rep").join(group, F.col("rep") == F.col("node"), "left").select(
        "sid", F.coalesce("component", "rep").alias("component")), "set-components")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(result, "sid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _several_texts(rows: DataFrame) -> DataFrame:
    """Ids whose rows have different sets."""
    return rows.groupBy("doc_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("doc_id")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, one row for repeated ids; rows without an id stay."""
    # ids that go are fewer than those that stay, so the texts meet only these and the repeated ids
    ids = cut(joined(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("component_id").alias("component"), F.count(F.lit(1)).alias("held")), "groups")
    gone = cut(ids.where("doc_id <> component OR held > 1").select(F.col("doc_id").alias("_id")), "gone")
    again = cut(ids.where("doc_id = component AND held > 1").select(F.col("doc_id").alias("_id")), "repeated")
    rows = packed(docs).withColumn("_id", F.col("_row.doc_id").cast("long"))
    once = rows.join(gone, "_id", "left_anti").select("_row")
    return unpacked(once.unionByName(rows.join(again, "_id", "left_semi").dropDuplicates(["_id"]).select("_row")))
