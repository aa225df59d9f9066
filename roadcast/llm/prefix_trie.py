"""Prefix trie of conversations, built on a broadcast skeleton of splitter paths.

A conversation's path is the sequence of its turns' digests (16 bytes of the SHA-256 of role and text); a node is a
distinct prefix of a path. Sorted by path, the members of a node are neighbours.

1. Each conversation becomes one row: its path, the length of each turn's text, its id. Texts aren't shuffled.
2. Splitters cut the order of (path, id) into ranges of about ``shard_turns`` turns, by a sample of paths drawn by hash
   of the id (DRAWN_EACH a range, LEAST_DRAWN at least). A group of equal paths is cut between ids.
3. The skeleton is the trie of all prefixes of the splitters' paths. If two ranges share a node, the splitter between
   them has the node's prefix, so every other node lies whole in one range. The skeleton is broadcast; its size is
   checked, and splitters are thinned out evenly until it fits SKELETON_BYTES.
4. Each range is one sorted shard, read in order with a stack of open nodes. Nodes outside the skeleton are finished
   there. For each skeleton node it meets, a shard gives one partial aggregate, at most two paths of them.
5. Partial aggregates are added up by node; one pass over the skeleton in preorder then adds subtrees to their parents.
   Nodes below a skeleton node get its smallest member by a join.
6. SHA-256 is sequential: for skeleton nodes shards give the members that end there as pieces of text, which are hashed
   in order of shard and piece, one after the other, never held together.

Ids ascend inside equal paths, so a node's ending members arrive in numeric order.

Cases: a null role or text is an empty one; a null turn comes first, equal turns in the order of their digests (repeated
rows are turns of their own); rows with a null conv_id belong to no conversation; a conversation without turns is a
member of the root only; an empty table has no nodes, not even a root; further columns are ignored. A conversation's
path is one value of 24 bytes a turn, as a document's text is one value.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadcast.llm.shared import cut

SHARD_TURNS, SKELETON_BYTES = 1 << 14, 16 << 20
DRAWN_EACH, LEAST_DRAWN = 8, 4096
WIDTH, PIECE = 16, 1 << 16


def head_turns(conv_id: Column) -> Column:
    """Turns taken from the conversation of the hundred's first id: unsigned crc32 of the decimal id, modulo 6."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): struct(digest, n) of each turn in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("d"), F.length(text).cast("long").alias("n")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv_id", F.expr("transform(t, x -> struct(x.d AS d, x.n AS n))").alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation with its first turns from the hundred's first conversation."""
    turns = cut(turns, "turns")
    heads = cut(turns.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head")), "heads")
    rows = turns.withColumn("h", head_turns(F.col("conv_id")).cast("int")).withColumn("base", F.expr("conv_id - conv_id % 100"))
    rows = rows.join(heads, "base", "left")
    return rows.select("conv_id", F.expr("concat(slice(coalesce(head, array()), 1, h), slice(turns, h + 1, size(turns)))").alias("turns"))


def pathed(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): digests side by side, and the code points of each turn's text."""
    return turns.select("conv_id", F.expr("array_join(transform(turns, x -> hex(x.d)), '')").alias("path"),
                        F.expr("transform(turns, x -> x.n)").alias("sizes")).withColumn("path", F.unhex("path"))


class Skeleton(NamedTuple):
    """Nodes are numbered in preorder, 0 is the root."""
    splitters: list[tuple[bytes, int]]
    children: dict[tuple[int, bytes], int]
    parents: list[int]

    @staticmethod
    def of(splitters: list[tuple[bytes, int]]) -> Skeleton:
        children, parents = {}, [-1]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), WIDTH):
                step = (node, path[at:at + WIDTH])
                if step not in children:
                    children[step] = len(parents)
                    parents.append(node)
                node = children[step]
        return Skeleton(splitters, children, parents)


def skeleton(paths: DataFrame, shard_turns: int = SHARD_TURNS, drawn_each: int = DRAWN_EACH, most_bytes: int = SKELETON_BYTES) -> Skeleton:
    """Splitters at equal numbers of turns in a sample of at most some DRAWN_EACH conversations for each range."""
    whole = paths.agg(F.count(F.lit(1)), F.sum(F.size("sizes") + 1), F.sum(F.octet_length("path") + WIDTH)).first()
    convs, turns, size = (x or 0 for x in whole)
    ranges = min(-(-turns // shard_turns), convs)
    ranges = min(ranges, max(2, int(most_bytes * convs / max(size, 1))))
    if ranges < 2:
        return Skeleton.of([])
    share = min(1.0, max(drawn_each * ranges, LEAST_DRAWN) / convs)
    drawn = paths.where(F.pmod(F.xxhash64(F.lit(13), "conv_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    drawn = drawn.select("path", "conv_id", (F.size("sizes") + 1).alias("turns"))
    ranged = drawn.selectExpr("path", "conv_id", f"floor((sum(turns) OVER (ORDER BY path, conv_id) - turns) * {ranges} / sum(turns) OVER ()) AS range")
    first = cut(ranged.groupBy("range").agg(F.min(F.struct("path", "conv_id")).alias("s")).where("range > 0"), "splitters")
    kept, held = [], 0
    for r in first.orderBy("s").toLocalIterator():
        held += len(r["s"]["path"]) + WIDTH
        if held <= most_bytes:
            kept.append((bytes(r["s"]["path"]), r["s"]["conv_id"]))
    return Skeleton.of(kept)


class _Open:
    """A node on the stack."""
    __slots__ = ("kids", "leaves", "saved", "convs", "least", "n", "ends", "skeletal", "piece", "pieces", "children", "ended")

    def __init__(self, n: int, skeletal: int):
        self.kids = self.leaves = self.saved = self.convs = self.pieces = 0
        self.least, self.n, self.skeletal = None, n, skeletal
        self.ends, self.ended, self.piece = hashlib.sha256(), False, []
        self.children: list[tuple] = []


#: Rows of a shard. kind 0: a finished node; 1: a partial aggregate; 2: a piece of the ids that end at a skeleton node.
SHARD_ROWS = ("kind int, conv_id long, depth int, parent_conv_id long, skeletal int, n_convs long, n_children long, n_leaves long, "
              "saved_tokens long, ends binary, shard int, piece int, n long")
_NAMES = [c.split()[0] for c in SHARD_ROWS.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = [_TYPES[c.split()[1]] for c in SHARD_ROWS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW)], _NAMES)


def _shard_rows(shard: int, members: Iterator[tuple[int, bytes, list[int]]], plan: Skeleton) -> Iterator[tuple]:
    """One pass over a shard's members in order of (path, id)."""
    out: list[tuple] = []
    stack = [_Open(0, 0)]
    steps: list[bytes] = []

    def flush(node: _Open) -> None:
        text = ",".join(node.piece).encode()
        out.append((2, None, None, None, node.skeletal, None, None, None, None, text, shard, node.pieces, None))
        node.pieces, node.piece = node.pieces + 1, []

    def close() -> None:
        node, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        if above is not None:
            above.convs += node.convs
            above.least = node.least if above.least is None else min(above.least, node.least)
        if node.skeletal >= 0:
            if node.piece:
                flush(node)
            out.append((1, node.least, depth, None, node.skeletal, node.convs, node.kids, node.leaves, node.saved, None, shard, None, node.n))
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.convs - 1) * node.n
        out.extend((0, *first, node.least, None, *rest, None, None, None) for first, rest in node.children)
        above.kids += 1
        above.leaves += leaves
        above.saved += saved
        first, rest = (node.least, depth), (node.convs, node.kids, leaves, saved, node.ends.digest())
        if above.skeletal >= 0:  # its smallest member is known after all shards
            out.append((0, *first, None, above.skeletal, *rest, None, None, None))
        else:
            above.children.append((first, rest))

    for conv_id, path, sizes in members:
        own = [path[at:at + WIDTH] for at in range(0, len(path), WIDTH)]
        shared = 0
        for a, b in zip(steps, own):
            if a != b:
                break
            shared += 1
        while len(stack) > shared + 1:
            close()
        if out:
            yield from out
            out.clear()
        for step, n in zip(own[shared:], sizes[shared:]):
            at = stack[-1].skeletal
            stack.append(_Open(n, plan.children.get((at, step), -1) if at >= 0 else -1))
        steps = own
        end = stack[-1]
        end.convs += 1
        end.least = conv_id if end.least is None else min(end.least, conv_id)
        if end.skeletal >= 0:
            end.piece.append(str(conv_id))
            if len(end.piece) * 8 >= PIECE:
                flush(end)
        else:
            end.ends.update(b",%d" % conv_id if end.ended else b"%d" % conv_id)
            end.ended = True
    if steps or stack[0].convs:
        while stack:
            close()
    yield from out


def shards(paths: DataFrame, plan: Skeleton) -> DataFrame:
    """SHARD_ROWS of every range."""
    spark = paths.sparkSession
    shared = spark.sparkContext.broadcast(plan)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value.splitters
        for b in batches:
            at = [bisect.bisect_right(splitters, (p, c)) for c, p in zip(b.column("conv_id").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], ["shard", *b.schema.names])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("shard", "conv_id", "path", "sizes")))
        out = []
        pending = rows()
        ahead = next(pending, None)
        while ahead is not None:
            shard = ahead[0]

            def members() -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and ahead[0] == shard:
                    yield ahead[1:]
                    ahead = next(pending, None)
            for row in _shard_rows(shard, members(), shared.value):
                out.append(row)
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    dealt = paths.select("conv_id", "path", "sizes").mapInArrow(deal, "shard int, conv_id long, path binary, sizes array<long>")
    dealt = dealt.repartitionById(len(plan.splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    return dealt.mapInArrow(finish, SHARD_ROWS)


def _combined(partials: DataFrame, plan: Skeleton) -> DataFrame:
    """Sums of each skeleton node's partial aggregates, then of its subtree; the skeleton has a checked size, so one task takes it."""
    shared = partials.sparkSession.sparkContext.broadcast(plan.parents)
    added = partials.groupBy("skeletal").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("n").alias("n"))

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents = shared.value
        rows = {r["skeletal"]: r for b in batches for r in b.to_pylist()}
        for k in sorted(rows, reverse=True):  # children have larger numbers than their parents
            r = rows[k]
            r["n_leaves"] = r["n_leaves"] or 1
            r["saved_tokens"] += (r["n_convs"] - 1) * r["n"]
            if k:
                above = rows[parents[k]]
                above["n_children"] += 1
                above["n_leaves"] += r["n_leaves"]
                above["saved_tokens"] += r["saved_tokens"]
        if rows:
            out = [{**r, "parent_conv_id": rows[parents[k]]["conv_id"] if k else None} for k, r in rows.items()]
            names = ["skeletal", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, kinds)], names)

    return added.repartition(1).mapInArrow(
        climb, "skeletal int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")


def _hashed_ends(pieces: DataFrame) -> DataFrame:
    """(skeletal, ends): pieces hashed in order as they stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(k: int, state) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([state.digest()], pa.binary())], ["skeletal", "ends"])
        now, state = None, None
        for b in batches:
            for k, text in zip(b.column("skeletal").to_pylist(), b.column("ends").to_pylist()):
                if k != now:
                    if now is not None:
                        yield row(now, state)
                    now, state = k, hashlib.sha256(text)
                else:
                    state.update(b"," + text)
        if now is not None:
            yield row(now, state)

    return pieces.repartition("skeletal").sortWithinPartitions("skeletal", "shard", "piece").select("skeletal", "ends").mapInArrow(
        run, "skeletal int, ends binary")


def nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node; paths: as of ``pathed``."""
    plan = skeleton(paths, shard_turns)
    rows = cut(shards(paths, plan), "trie-shards")
    top = cut(_combined(rows.where("kind = 1").select("skeletal", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "n"), plan),
              "trie-skeleton")
    names = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = top.join(_hashed_ends(rows.where("kind = 2").select("skeletal", "shard", "piece", "ends")), "skeletal", "left")
    upper = ends.select("conv_id", "depth", "parent_conv_id", *names, F.coalesce(F.hex("ends"), F.hex(F.unhex(F.sha2(F.lit(b""), 256)))).alias("ends"))
    above = top.select("skeletal", F.col("conv_id").alias("_above"))
    lower = rows.where("kind = 0").join(above, "skeletal", "left")
    lower = lower.select("conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), *names, F.hex("ends").alias("ends"))
    return upper.unionByName(lower).select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *names,
                                           F.lower("ends").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the rebuilt conversations."""
    return nodes(cut(pathed(rebuilt(turn_paths(conversations))), "paths"), shard_turns)
