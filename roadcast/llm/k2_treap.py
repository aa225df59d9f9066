"""Ranked lexical search on K2-treaps over the term-document grid.

A block is a range of documents with the grid of their terms: rows are the block's terms, most frequent first, columns
its documents, shortest first, so that neighbours in either direction have similar impacts. A cell of the grid is a
quadrant of the cell above; it stores the largest impact inside and which of its quadrants hold anything. A cell with a
single point is stored as that point (compressed), so rare terms cost no chains of cells. Impacts are the integers of
the score before a term's weight: they depend on the document and on sums over the corpus, not on the item.

1. One scan counts each document's terms, for the number of documents and of terms.
2. A second scan builds a block of every BLOCK_POSTINGS postings or BLOCK_DOCS documents and writes it; there is no
   shuffle. Every document is indexed.
3. Document frequencies of the items' terms are summed from the blocks' lexicons.
4. Search: an item's terms are rows; a state is a range of documents with the cells of those rows, its bound the sum of
   weight times the cells' maxima. States with the highest bounds are split into the two halves of their range, each row
   going down into its quadrant, until nothing has a bound that reaches the item's k-th best score, which is carried on
   from block to block of a task. TOGETHER items go down at once in flat arrays; at each step an item splits its best STATES.
5. Tasks give each item's best k, which meet in two rounds of ranking, by tile and then by item.

Items are asked in batches of about ITEM_BYTES of text, one search each, so what is sent to the tasks is bounded. A
task's memory doesn't grow with its share of the input: texts come WIDE_ROWS at once, blocks one by one, and a file holds
FILE_BLOCKS blocks, as parquet's writer and reader keep a file's first hundred rows in memory whatever their size.

Scores are exact integers. Cases: null texts, empty texts and texts without terms are not counted and never found; items
without terms or with a null id find nothing; rows that share an item_id are one item, whose terms are those of all of
them; documents are rows, so repeated rows rank one after the other; equal scores rank by ascending doc_id, null last;
an empty table on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadcast.llm.shared import WIDE_ROWS, arrow_rows, cut

#: Terms of UTF-8 text: ASCII letters and digits and every byte of other signs.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BLOCK_POSTINGS, BLOCK_DOCS, FILE_BLOCKS = 1 << 18, 1 << 13, 8
ITEM_BYTES, TOGETHER, STATES, TILES = 4 << 20, 32, 160, 64
BLOCK = "docs binary, lexicon binary, held binary, levels int, masks array<binary>, tops array<binary>, points array<binary>"
_BITS = np.array([bin(m).count("1") for m in range(16)], dtype=np.int64)


class Corpus(NamedTuple):
    documents: int
    terms: int

    def length_norm(self, n: int) -> int:
        return 100 - 50 + (50 * n * self.documents) // self.terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.lower()) if text else []  # lower() of bytes maps only A-Z


def measured(docs: DataFrame) -> Corpus:
    """Documents with a term, and all terms with repeats."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for b in batches:
            for x in b.column(0).cast(pa.binary()):
                n = len(TERM.findall(x.as_py())) if x.is_valid else 0
                documents, terms = documents + bool(n), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])

    with arrow_rows(docs.sparkSession, WIDE_ROWS):
        sums = docs.select("text").mapInArrow(count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return Corpus(*(x or 0 for x in sums))


def _interleaved(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Morton codes, a row's bit above a column's."""
    def spread(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | (x << np.uint64(shift))) & np.uint64(mask)
        return x
    return (spread(rows) << np.uint64(1)) | spread(columns)


def quadtree(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> tuple[int, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(levels, masks, tops, points): for each level from the root on its cells' quadrants, maxima and, with an empty
    mask, the place of a cell's only point. Children of a level's cells stand in order in the next."""
    code = _interleaved(rows, columns)
    order = np.argsort(code, kind="stable")
    code, impact = code[order], impacts[order].astype(np.int64)
    levels = max(1, int(max(rows.max(), columns.max())).bit_length())
    masks, tops, points = [], [], []
    live = np.arange(len(code))  # points that no compressed cell has taken yet
    for level in range(levels + 1):
        below = np.uint64(2 * (levels - level))
        prefix = code[live] >> below
        first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        size = np.diff(np.r_[first, len(prefix)])
        tops.append(np.maximum.reduceat(impact[live], first).astype(np.uint32))
        alone = size == 1
        mask = np.zeros(len(first), dtype=np.uint8)
        rest = np.repeat(~alone, size)
        if rest.any():
            quadrant = ((code[live] >> (below - np.uint64(2))) & np.uint64(3)).astype(np.uint8)
            mask = np.where(alone, np.uint8(0), np.bitwise_or.reduceat(np.uint8(1) << quadrant, first))
        masks.append(mask)
        points.append(code[live[first[alone]]])
        live = live[rest]
        if not len(live):
            break
    return levels, masks, tops, points


class _Builder:
    """A block in the making: terms are numbered as they come, documents kept as numbers and frequencies."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.rows: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        number, counts = self.number, Counter(terms)
        self.ids.append(doc_id)
        self.sizes.append(len(terms))
        self.rows.append(np.array([number.setdefault(t, len(number)) for t in counts], dtype=np.int32))
        self.tfs.append(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))
        self.postings += len(counts)

    def full(self) -> bool:
        return self.postings >= BLOCK_POSTINGS or len(self.ids) >= BLOCK_DOCS

    def block(self, corpus: Corpus) -> tuple:
        by_size = sorted(range(len(self.ids)), key=self.sizes.__getitem__)
        rows, tf = (np.concatenate([x[d] for d in by_size]) for x in (self.rows, self.tfs))
        columns = np.repeat(np.arange(len(by_size)), [len(self.rows[d]) for d in by_size])
        norm = np.array([corpus.length_norm(self.sizes[d]) for d in by_size], dtype=np.int64)[columns]
        held = np.bincount(rows, minlength=len(self.number))
        order = np.argsort(-held, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        words = list(self.number)
        levels, masks, tops, points = quadtree(place[rows], columns, (1_000_000_000 * tf) // (1000 * tf + 20 * norm))
        ids = np.array([[self.ids[d] is not None, self.ids[d] or 0] for d in by_size], dtype="<i8")
        return (ids.tobytes(), b" ".join([words[k] for k in order]), held[order].astype("<i4").tobytes(), levels,
                [m.tobytes() for m in masks], [t.astype("<u4").tobytes() for t in tops], [p.astype("<u8").tobytes() for p in points])


def index(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """A row for each block of documents, written to the shared folder."""
    names = [c.split()[0] for c in BLOCK.split(", ")]
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), *[pa.list_(pa.binary())] * 3]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(some.block(corpus), kinds)], names)
        some = _Builder()
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1).cast(pa.binary())):
                terms = terms_of(text.as_py())
                if terms:
                    some.add(doc_id.as_py(), terms)
                if some.full():
                    yield row()
                    some = _Builder()
        if some.ids:
            yield row()

    with arrow_rows(docs.sparkSession, WIDE_ROWS):
        return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, BLOCK), "k2-blocks", maxRecordsPerFile=FILE_BLOCKS)


def _frequencies(blocks: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the terms."""
    shared = blocks.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for lexicon, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held = np.frombuffer(held, dtype="<i4")
                total.update({t: int(held[k]) for k, t in enumerate(lexicon.split(b" ")) if t in shared.value})
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    rows = blocks.select("lexicon", "held").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    with arrow_rows(blocks.sparkSession, 1):
        return {bytes(r["term"]): r["n"] for r in rows.collect()}


class Block:
    """A block in memory: for each level its cells' quadrants, maxima, first child or point."""

    def __init__(self, row: dict):
        ids = np.frombuffer(row["docs"], dtype="<i8").reshape(-1, 2)
        self.known, self.ids = ids[:, 0] == 1, ids[:, 1]
        self.row = {t: k for k, t in enumerate(row["lexicon"].split(b" "))}
        self.levels = row["levels"]
        self.masks = [np.frombuffer(m, dtype=np.uint8) for m in row["masks"]]
        self.tops = [np.frombuffer(t, dtype="<u4") for t in row["tops"]]
        self.first, self.point = [], []
        for mask, points in zip(self.masks, row["points"]):
            self.first.append((np.cumsum(_BITS[mask]) - _BITS[mask]).astype(np.int32))
            at = np.full(len(mask), -1, dtype=np.int64)
            at[mask == 0] = np.frombuffer(points, dtype="<u8").astype(np.int64)
            self.point.append(at)


def _squeezed(code: np.ndarray) -> np.ndarray:
    """The column of a Morton code; of the code shifted by one, the row."""
    x = code & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> shift)) & mask
    return x


class _Paths(NamedTuple):
    """Rows' paths through cells, side by side; the paths of one state stand together."""
    state: np.ndarray
    row: np.ndarray
    weight: np.ndarray
    top: np.ndarray
    cell: np.ndarray  # -1 with a column instead, once only one point is left
    column: np.ndarray

    def take(self, at: np.ndarray) -> _Paths:
        return _Paths(*(x[at] for x in self))


class Ranking:
    """Best k of each item: scores and documents, largest first."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.least = np.ones(items, dtype=np.int64)  # what a score must reach to change the result

    def add(self, item: int, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        rows = self.best[item] + [(-s, not n, d) for s, n, d in zip(scores.tolist(), known.tolist(), ids.tolist())]
        rows.sort()
        self.best[item] = rows[:self.k]
        if len(rows) >= self.k:
            self.least[item] = -self.best[item][-1][0]


def search(block: Block, items: list[list[tuple[bytes, int]]], ranking: Ranking) -> None:
    """Adds the block's documents that can be among an item's best k."""
    for lo in range(0, len(items), TOGETHER):
        asked = [(q, block.row[t], w) for q, terms in enumerate(items[lo:lo + TOGETHER], lo) for t, w in terms if t in block.row and w > 0]
        if asked:
            _descend(block, asked, ranking)


def _descend(block: Block, asked: list[tuple[int, int, int]], ranking: Ranking) -> None:
    """Best-first, for all (item, row, weight) together."""
    item_of, rows, weights = (np.array(x, dtype=np.int64) for x in zip(*asked))
    owner, state = np.unique(item_of, return_inverse=True)  # one state for each item: the whole range
    n = len(rows)
    root = block.point[0][0]
    paths = _Paths(state, rows, weights, np.full(n, int(block.tops[0][0])), np.full(n, -1 if root >= 0 else 0), np.full(n, 0))
    if root >= 0:  # the block is one point
        paths = paths.take(rows == _squeezed(np.array([root >> 1]))[0])
        paths = paths._replace(column=np.full(len(paths.row), _squeezed(np.array([root]))[0]))
    # states wait by level, so that a split needs one level's arrays; a level's states are in flat arrays
    waiting: list[list] = [[] for _ in range(block.levels + 1)]
    _wait(waiting, 0, owner, np.zeros(len(owner), dtype=np.int64), paths, ranking)
    while any(waiting):
        held = [(level, *_joined(some)) for level, some in enumerate(waiting) if some]
        waiting = [[] for _ in range(block.levels + 1)]
        item_all, bound_all = (np.concatenate([h[i] for h in held]) for i in (1, 3))
        order = np.lexsort((-bound_all, item_all))
        start = np.flatnonzero(np.r_[True, np.diff(item_all[order]) > 0])
        nth = np.empty(len(order), dtype=np.int64)
        nth[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        at = 0
        for level, item, low, bound, parts in held:
            live, first = bound >= ranking.least[item], nth[at:at + len(item)] < STATES
            at += len(item)
            if (live & ~first).any():
                waiting[level].append(_some(item, low, bound, parts, live & ~first))
            if not (live & first).any():
                continue
            item, low, bound, parts = _some(item, low, bound, parts, live & first)
            if level < block.levels:
                _split(block, level, item, low, parts, waiting, ranking)
            else:
                for q in np.unique(item):
                    own = low[item == q]
                    ranking.add(int(q), bound[item == q], block.known[own], block.ids[own])


def _joined(entries: list) -> tuple:
    """A level's waiting states as one."""
    if len(entries) > 1:
        shift = np.cumsum([0] + [len(e[0]) for e in entries[:-1]])
        paths = _Paths(*(np.concatenate(x) for x in zip(*(e[3]._replace(state=e[3].state + s) for e, s in zip(entries, shift)))))
        entries[:] = [(*(np.concatenate([e[i] for e in entries]) for i in range(3)), paths)]
    return entries[0]


def _some(item: np.ndarray, low: np.ndarray, bound: np.ndarray, paths: _Paths, which: np.ndarray) -> tuple:
    """The states that ``which`` marks, with their paths."""
    number = np.cumsum(which) - 1
    paths = paths.take(np.flatnonzero(which[paths.state]))
    return item[which], low[which], bound[which], paths._replace(state=number[paths.state])


def _wait(waiting: list[list], level: int, item: np.ndarray, low: np.ndarray, paths: _Paths, ranking: Ranking) -> None:
    bound = np.zeros(len(item), dtype=np.int64)
    np.add.at(bound, paths.state, paths.weight * paths.top)
    which = bound >= ranking.least[item]
    if which.any():
        waiting[level].append(_some(item, low, bound, paths, which))


def _split(block: Block, level: int, item: np.ndarray, low: np.ndarray, paths: _Paths, waiting: list[list], ranking: Ranking) -> None:
    """Both halves of each state's range, every path going down into its row's quadrant."""
    bit = block.levels - level - 1
    inner = paths.cell >= 0
    lone = paths.take(np.flatnonzero(~inner))
    lone = lone._replace(state=2 * lone.state + ((lone.column >> bit) & 1))
    wide = paths.take(np.flatnonzero(inner))
    mask, first = block.masks[level][wide.cell], block.first[level][wide.cell]
    parts = [lone]
    for half in (0, 1):
        quadrant = (((wide.row >> bit) & 1) << 1) | half
        there = np.flatnonzero((mask >> quadrant) & 1)
        child = first[there] + _BITS[mask[there] & ((1 << quadrant[there]) - 1)]
        point = block.point[level + 1][child]
        down = wide.take(there)
        single = point >= 0
        down = down._replace(state=2 * down.state + half, top=block.tops[level + 1][child].astype(np.int64), cell=np.where(single, -1, child),
                             column=np.where(single, _squeezed(point), 0))
        parts.append(down.take(np.flatnonzero(~single | (_squeezed(point >> 1) == down.row))))
    both = _Paths(*(np.concatenate(x) for x in zip(*parts)))
    lows = np.repeat(low, 2)
    lows[1::2] += 1 << bit
    _wait(waiting, level + 1, np.repeat(item, 2), lows, both, ranking)


def _batches(items: DataFrame) -> list[list[tuple[int, set[bytes]]]]:
    """Items' ids and terms, in parts of about ITEM_BYTES."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // ITEM_BYTES) or 1
    for part in range(n):
        held: dict[int, set[bytes]] = {}
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part).toLocalIterator():
            held.setdefault(r["item_id"], set()).update(terms_of(r["text"].encode()))
        yield sorted((q, terms) for q, terms in held.items() if terms)


def _candidates(blocks: DataFrame, ids: list[int], items: list[list[tuple[bytes, int]]], k: int) -> DataFrame:
    """Each task's best k of every item."""
    shared = blocks.sparkSession.sparkContext.broadcast((ids, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = shared.value
        ranking = Ranking(len(items), k)
        for b in batches:
            for i in range(len(b)):
                search(Block(b.slice(i, 1).to_pylist()[0]), items, ranking)
        for lo in range(0, len(ids), 1000):
            rows = [(ids[q], -s, None if hidden else d) for q in range(lo, min(lo + 1000, len(ids))) for s, hidden, d in ranking.best[q]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item_id", "score", "doc_id"])

    return blocks.mapInArrow(run, "item_id long, score long, doc_id long")


def top_k(blocks: DataFrame, corpus: Corpus, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest scores of each item over an index."""
    found = None
    for batch in _batches(items):
        df = _frequencies(blocks, set().union(*(terms for _, terms in batch))) if batch else {}
        asked = [sorted((t, corpus.weight(df[t])) for t in terms if t in df) for _, terms in batch]
        with arrow_rows(blocks.sparkSession, 1):
            some = cut(_candidates(blocks, [q for q, _ in batch], asked, k), "k2-found")
        found = some if found is None else found.unionByName(some)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    tiled = found.withColumn("_tile", F.spark_partition_id() % TILES)
    tiled = tiled.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_tile").orderBy(*order))).where(F.col("rank") <= k)
    ranked = tiled.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_all(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Index of all documents, then each item's k best."""
    corpus = measured(docs)
    return top_k(index(docs, corpus), corpus, items, k)
