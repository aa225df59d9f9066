"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from roadcast.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_nodes long"


def brute(rows):
    own = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((turn is not None, turn or 0), key, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = set()
    for p, ms in members.items():
        below = [q for q in members if q[:len(p)] == p]
        children = {q[:len(p) + 1] for q in below if len(q) > len(p)}
        leaves = sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in members) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        text = ",".join(map(str, sorted(ends.get(p, []))))
        out.add((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children), leaves, saved,
                 hashlib.sha256(text.encode()).hexdigest()))
    return out


def rows_of(seed, n=260):
    rng = random.Random(seed)
    texts = ["", "hi", "héllo 😀", "so", None, "what"]
    rows = []
    for c in rng.sample(range(400), n) + [0, 100]:
        for turn in range(rng.choice([0, 1, 2, 3, 9])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(texts), 7))
    rows += [(1000 + k, t, "user", f"same {t}", 1) for k in range(0, 60) for t in range(7)]  # a large group of copies
    rows += [(2000, t, "user", str(t), 1) for t in range(300)] + [(None, 1, "user", "no id", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [40, 1 << 14])
def test_nodes_equal_brute_force(spark, shard_turns):
    rows = rows_of(shard_turns)
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), shard_turns).collect()
    expected = brute(rows)
    assert len(found) == len(expected)
    assert {tuple(r) for r in found} == expected


def test_skeleton_has_all_shared_nodes_and_keeps_its_size(spark):
    paths = prefix_trie.pathed(prefix_trie.rebuilt(prefix_trie.turn_paths(spark.createDataFrame(rows_of(5), SCHEMA)))).cache()
    plan = prefix_trie.skeleton(paths, 40)
    assert len(plan.splitters) > 5 and plan.splitters == sorted(plan.splitters)
    assert sum(p.startswith(bytes(paths.where("conv_id = 1003").first()["path"])[:16]) for p, _ in plan.splitters) > 1  # a group is cut
    shard = prefix_trie.shards(paths, plan).where("kind = 0").select("conv_id", "depth")
    assert shard.distinct().count() == shard.count()
    small = prefix_trie.skeleton(paths, 40, most_bytes=600)
    assert sum(len(p) + 16 for p, _ in small.splitters) <= 600
    paths.unpersist()


def test_pieces_of_ids_are_hashed_in_order(spark, monkeypatch):
    rows = [(k, 0, "user", "same", 0) for k in range(5, 3000, 1)]
    monkeypatch.setattr(prefix_trie, "PIECE", 80)
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), 500).collect()
    assert {tuple(r) for r in found} == brute(rows)


def test_empty_and_idless_tables(spark):
    for rows in ([], [(None, 0, "user", "x", 0)]):
        assert prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 4)
    rows = [(c, 0, "user", "x", 0)]
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in found} == brute(rows) and len(found) == 1
