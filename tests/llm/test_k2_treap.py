"""Ranked search on K2-treaps against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from roadcast.llm import k2_treap
from roadcast.llm.shared import ARROW_ROWS

DOCS = "doc_id long, text string, score long, item_id long"
ITEMS = "item_id long, text string, rank int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t, *_ in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, text, _ in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, ts in asked.items():
        rows = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(i, r, None if hidden else d, -s) for r, (s, hidden, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def tables(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(300)] + ["The", "of", "école", "ÉCOLE", "日本", "a", "İz", "K"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(d, rng.choice([" ", "-", " . "]).join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 40, 200]))), 1, 2) for d in range(n)]
    docs += [docs[5], docs[5], (700, docs[7][1], 0, 0), (None, docs[7][1], 0, 0), (701, None, 0, 0), (702, "", 0, 0), (703, "?!", 0, 0),
             (704, " ".join(vocabulary) * 30, 0, 0)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20]))), 0) for i in range(30)]
    items += [(50, None, 0), (51, "", 0), (52, "unheard words", 0), (None, "t1 t2", 0), (3, "t5 t6 t5", 0)]
    return docs, items


@pytest.mark.parametrize("block_docs,states,k", [(1 << 13, 160, 50), (16, 3, 7), (1, 1, 5)])
def test_top_k_equals_brute_force(spark, monkeypatch, block_docs, states, k):
    monkeypatch.setattr(k2_treap, "ITEM_BYTES", 300)
    docs, items = tables(block_docs)
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    corpus = k2_treap.measured(frame)

    def blocks(batches):  # blocks of the wanted size, built in the workers
        k2_treap.BLOCK_DOCS, k2_treap.STATES = block_docs, states
        yield from batches
    found = k2_treap.top_k(k2_treap.index(frame.mapInArrow(blocks, DOCS), corpus).mapInArrow(blocks, k2_treap.BLOCK), corpus,
                           spark.createDataFrame(items, ITEMS), k)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, k)


def test_a_task_holds_few_texts_and_blocks_at_once(spark, monkeypatch):
    asked, cut = [], k2_treap.cut
    monkeypatch.setattr(k2_treap, "cut", lambda df, *a, **b: asked.append(int(spark.conf.get(ARROW_ROWS))) or cut(df, *a, **b))
    frame = spark.createDataFrame([(d, f"a b{d % 7}", 0, 0) for d in range(40)], DOCS).coalesce(1)
    corpus = k2_treap.measured(frame)

    def single(batches):  # a block for each document, built in the workers
        k2_treap.BLOCK_DOCS = 1
        yield from batches
    blocks = k2_treap.index(frame.mapInArrow(single, DOCS), corpus)
    assert len(blocks.inputFiles()) == 5 and blocks.count() == 40
    assert k2_treap.top_k(blocks, corpus, spark.createDataFrame([(1, "b3", 0)], ITEMS), 3).count() == 3
    assert asked == [1000, 1]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 0, 0)], DOCS), spark.createDataFrame([(1, "a", 0)], ITEMS)
    assert k2_treap.search_all(docs.limit(0), items).collect() == []
    assert k2_treap.search_all(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_quadtree_holds_every_point_and_the_maxima(seed):
    rng = np.random.default_rng(seed)
    places = np.unique(rng.integers(0, [1, 40, 300, 5000][seed] + 1, size=([1, 60, 900, 900][seed], 2)), axis=0)
    rows, columns, impacts = places[:, 0], places[:, 1], rng.integers(1, 1_000_000, len(places))
    levels, masks, tops, points = k2_treap.quadtree(rows, columns, impacts)
    found = {}

    def down(level, cell, at):  # at: Morton code of the cell's first place
        if not masks[level][cell] and level < levels or level == levels:
            code = int(points[level][np.cumsum(masks[level] == 0)[cell] - 1])
            found[code] = int(tops[level][cell])
            return int(tops[level][cell])
        before = int(k2_treap._BITS[masks[level][:cell]].sum())
        below = []
        for q in range(4):
            if masks[level][cell] >> q & 1:
                below.append(down(level + 1, before, at))
                before += 1
        assert max(below) == tops[level][cell]
        return max(below)
    down(0, 0, 0)
    codes = k2_treap._interleaved(rows, columns)
    assert found == dict(zip(codes.tolist(), impacts.tolist()))
    assert (k2_treap._squeezed(codes.astype(np.int64)) == columns).all() and (k2_treap._squeezed(codes.astype(np.int64) >> 1) == rows).all()


def test_search_leaves_out_ranges_that_cannot_reach_the_best():
    rng = random.Random(2)
    texts = [[f"w{rng.randrange(2000)}" for _ in range(40)] for _ in range(2000)]
    counts = [Counter(t.encode() for t in text) for text in texts]
    some = k2_treap._Builder()
    for d, text in enumerate(texts):
        some.add(d, [t.encode() for t in text])
    corpus = k2_treap.Corpus(2000, 80_000)
    names = [c.split()[0] for c in k2_treap.BLOCK.split(", ")]
    block = k2_treap.Block(dict(zip(names, some.block(corpus))))
    df = Counter(t for c in counts for t in c)
    asked = [[(t, corpus.weight(df[t])) for t in counts[7]]]
    scored = []
    ranking = k2_treap.Ranking(1, 5)
    add = ranking.add
    ranking.add = lambda item, scores, known, ids: (scored.extend(ids.tolist()), add(item, scores, known, ids))
    k2_treap.search(block, asked, ranking)
    assert ranking.best[0][0][2] == 7 and len(scored) < sum(any(t in c for t in counts[7]) for c in counts)
