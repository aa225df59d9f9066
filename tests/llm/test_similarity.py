"""Vectors (op4, op8), the n-gram join (op6), components and the pipeline."""

import math
import operator
import random
import re
import sys
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from roadcast.llm import components as C
from roadcast.llm import flat_graph as G
from roadcast.llm import jaccard_join as J
from roadcast.llm import topk
from roadcast.llm import toxicity as T

VECTORS = "vec_id long, embedding array<float>, label int, rank string, n long"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, rep string, _id int"
NAN, INF = float("nan"), float("inf")


def vector_rows(seed=1, n=300, d=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    base[n // 2:] = base[rng.integers(0, 12, n - n // 2)] + 0.05 * rng.normal(size=(n - n // 2, d))
    rows = [(i, [float(np.float32(x)) for x in v], 0, "r", 1) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1], 0, "r", 1) for i in range(20)]
    rows += [(2000, None, 0, "r", 1), (2001, [0.0] * d, 0, "r", 1), (2002, [NAN] + [1.0] * (d - 1), 0, "r", 1), (2003, [INF] * d, 0, "r", 1), (2004, [None] + [1.0] * (d - 1), 0, "r", 1),
             (2005, [1.0, 2.0], 0, "r", 1), (2006, [2.0, 4.0], 0, "r", 1), (None, rows[3][1], 0, "r", 1), (2007, [], 0, "r", 1)]
    return rows


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


def test_near_duplicate_vectors_equal_brute_force(spark):
    rows = vector_rows()
    got = {r.vec_id: r for r in G.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, dtype=float)) for i, v, *_ in rows if i is not None and usable(v) and any(v)]
    links = {i: 0 for i, *_ in rows}
    pairs = []
    for i, v in good:
        for j, w in good:
            if i != j and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.95:
                links[i] += 1
                pairs.append((i, j))
    low = {i: i for i, *_ in rows}
    for _ in range(20):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= links[i] for i in links) and found >= 0.98 * sum(links.values())
    assert sum(got[i].component_id != low[i] for i in low if i is not None) <= 2
    assert all(got[i].kept == (got[i].vec_id == got[i].component_id) for i in low if i is not None)
    assert got[2005].n_links == 1 and got[2002].n_links == got[2000].n_links == 0 and got[None].n_links == 0


def test_robust_graph_search_recall_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    x[350:] = x[rng.integers(0, 30, 350)] + 0.04 * rng.normal(size=(350, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = G.robust_graph(x, 1)
    assert max(map(len, near)) <= 3 * G.DEGREE
    q, v, s = G.range_search(x, near, x, 0.95)
    truth = set(zip(*map(list, np.nonzero(x @ x.T >= 0.95))))
    assert set(zip(q.tolist(), v.tolist())) <= {(int(a), int(b)) for a, b in truth}
    assert len(q) >= 0.98 * len(truth)
    monkeypatch.setattr(G, "PART", 64)  # a shard in many parts loses nothing
    monkeypatch.setattr(G, "QUERIES", 50)
    rows = [(i, [float(a) for a in r], 0, "r", 1) for i, r in enumerate(x)]
    got = sum(r.n_links for r in G.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert got >= 0.98 * (len(truth) - 700)


def test_a_later_shard_repairs_what_the_first_one_misses(spark, monkeypatch):
    angle = np.r_[np.linspace(0, 0.2, 30), np.linspace(2.0, 2.2, 20)]
    x = np.c_[np.cos(angle), np.sin(angle)]
    rows = [(i, 1 + i % 3, 2, v.astype("<f8").tobytes()) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "rep long, copies long, d int, unit binary")
    centres = {2: np.array([[np.cos(a), np.sin(a)] for a in (0.1, 1.05, 2.1)])}  # shards of 30, 50 and 20 nodes
    whole, miss = G.range_search, [30]

    def search(x, *args):
        q, v, s = whole(x, *args)
        keep = np.full(len(q), len(x) not in miss) | (q % 2 == 0)
        return q[keep], v[keep], s[keep]

    monkeypatch.setattr(G, "range_search", search)
    links = G._links(nodes, 0.99, 2, centres).collect()
    near = (x @ x.T >= 0.99) & ~np.eye(50, dtype=bool)
    want = {i: sum(rows[j][1] for j in np.flatnonzero(near[i])) for i in range(50)}
    got = dict.fromkeys(range(50), 0)
    for r in links:
        if r.rep == r.other:
            got[r.rep] += r.n
    assert got == want
    assert {r.rep for r in links if r.rep != r.other} | {r.other for r in links if r.rep != r.other} == set(range(50))


def test_audit_sees_rare_links_and_counts_them_without_copies(spark):
    x = np.random.default_rng(6).normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1:3], x[5] = x[0], x[4]
    for i in (0, 4):
        x[i] += 0.001
    rows = [(i, 10**6 if i < 3 else 1, 32, v.astype("<f8").tobytes()) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "rep long, copies long, d int, unit binary")
    schema = "rep long, other long, n long, pairs long"
    assert G.audited_recall(nodes, spark.createDataFrame([], schema), 0.95) == 0.0
    hot = spark.createDataFrame([(i, i, 2 * 10**6, 2) for i in range(3)], schema)
    assert G.audited_recall(nodes, hot, 0.95) == 6 / 8


def test_search_widens_until_the_audit_passes(spark, monkeypatch):
    whole = G.range_search

    def search(x, neighbours, queries, threshold, seed=0, beam=24):
        q, v, s = whole(x, neighbours, queries, threshold, seed, beam)
        keep = np.full(len(q), beam > 24) | (q % 2 == 0)
        return q[keep], v[keep], s[keep]

    monkeypatch.setattr(G, "range_search", search)
    monkeypatch.setattr(G, "MOST_OVERLAP", 2)
    rows = vector_rows()
    got = G.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert min(r.recall for r in got) >= G.RECALL


def test_no_vectors(spark):
    assert G.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    one = G.near_duplicates(spark.createDataFrame([(1, None, 0, "r", 1)], VECTORS)).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in one] == [(1, 0, 1, True)]


def brute_top(rows, k):
    good = [(i, np.floor(64 * np.array(v, dtype=float))) for i, v, *_ in rows if i is not None and usable(v)]
    out = []
    for i, v in good:
        if i % 20 == 0:
            scored = sorted((-int(v @ w), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard,block,fan", [(8192, 2048, 16), (40, 5, 2)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, block, fan):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "FAN_IN", fan)
    rows = [r for r in vector_rows(2) if r[0] is not None]
    v = topk.quantised(spark.createDataFrame(rows, VECTORS))
    got = sorted(map(tuple, topk.top_k(v.where("id % 20 = 0"), v, 7).collect()))
    assert got == brute_top(rows, 7)


def test_top_k_of_few_and_huge(spark):
    schema = "vec_id long, embedding array<double>, label int, rank string, n long"
    v = topk.quantised(spark.createDataFrame([(20, [1e8, 1e8], 0, "", 1), (21, [-3e5, 5.0], 0, "", 1)], schema))
    got = topk.top_k(v.where("id % 20 = 0"), v, 20).collect()
    assert [tuple(r) for r in got] == [(20, 1, 21, 64 * 10**8 * 64 * (-3 * 10**5) + 64 * 10**8 * 320)]  # beyond 2**53
    v = topk.quantised(spark.createDataFrame([(20, [1e9, 1e9], 0, "", 1), (21, [-3e7, 5.0], 0, "", 1)], schema))
    assert [r.score for r in topk.top_k(v.where("id % 20 = 0"), v, 20).collect()] == [-2**63]  # beyond 64 bits: the nearest long
    assert topk.top_k(v.limit(0), v, 20).count() == 0


def test_top_k_keeps_finite_vectors_of_any_size(spark):
    rows = [(20, [1.5, -0.01]), (1, [2.0**57, 3.0]), (2, [1.7e308, 0.0]), (3, [0.3, 0.0]), (4, [-2.0**70 + 2.0**20, 2.0**52 + 1]),
            (5, [float("inf"), 0.0]), (6, [5e-324, -5e-324]), (40, [0.0, 0.0]), (60, [2.0**100, -2.0**100])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, topk.top_k(v.where("id % 20 = 0"), v, 20).collect()))
    whole = {i: [math.floor(64 * Fraction(x)) for x in e] for i, e in rows if i != 5}
    want = []
    for i in (20, 40, 60):
        scores = sorted((-max(-2**63, min(2**63 - 1, sum(map(operator.mul, whole[i], w)))), j) for j, w in whole.items() if j != i)
        want += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    assert got == want


# ---- n-gram join ----

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def near_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    texts = [None, "", "  \t\n", "one", "One", "one two", "ONE two", "É b c", "é b c", "A b c", "a B c"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(1, 30)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    hot = [word() for _ in range(150)]
    for _ in range(80):  # one large group: most are near the first, some only near others
        t = list(hot)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 4])):
            t[rng.randrange(len(t))] = word()
        texts.append("\n".join(t))
    return texts


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    for _ in range(30):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return [len(s) for s in sets], low


@pytest.mark.parametrize("small,block", [(24, 512), (2, 7)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK", block)
    texts = near_texts()
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.joined(df).collect()}
    sizes, low = brute_groups(texts)
    assert got == {i: (n, c) for i, (n, c) in enumerate(zip(sizes, low))}
    kept = J.first_of_groups(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, c in enumerate(low) if i == c]


def test_ngram_join_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (3, text), (None, text), (7, "other text entirely here"), (7, text + " tail"), (8, None), (8, None), (9, "x " * 50_000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in J.joined(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, None), (7, 3), (7, 3), (8, 8), (8, 8), (9, 9)], key=str)
    assert sorted((r.doc_id for r in J.first_of_groups(df).collect()), key=str) == sorted([3, None, 8, 9], key=str)
    assert J.joined(df.limit(0)).count() == 0 and J.first_of_groups(df.limit(0)).count() == 0


def test_portions_hash_alike(monkeypatch):
    texts = [(t or "").encode() for t in near_texts(3)]
    whole = J.shingle_sets(texts)
    for t, s in zip(texts, whole):
        assert np.array_equal(J.shingle_sets([t])[0], s) and len(s) == len(shingles(t.decode()))


def test_hashing_a_portion_holds_little_memory():
    rng = random.Random(5)
    texts = pa.array([" ".join(str(rng.randrange(10**6)) for _ in range(2000)) for _ in range(300)])
    J._POWERS.clear()
    tracemalloc.start()
    try:
        rows = sum(len(J.shingle_sets(some)) for _, some in J._portions(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and texts.nbytes > 4_000_000 and peak < 30e6, peak


def test_steps_on_whole_texts_and_sets_get_few_rows_at_once(spark, monkeypatch):
    seen, cut, rows = {}, J.cut, lambda: int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    monkeypatch.setattr(J, "cut", lambda df, name: seen.setdefault(name, []).append(rows()) or cut(df, name))
    before = rows()
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2) for i, t in enumerate(near_texts()[:60])], DOCS)
    assert J.joined(df).count() == 60 and rows() == before
    assert all(n <= 1000 for name in ("shingled", "candidates", "sets", "links") for n in seen[name]) and seen["postings"] == [10_000]


def test_scoring_portions_are_small():
    texts = ["x" * 300_000] * 20
    assert max(sum(map(len, some)) for some in T._portions(texts)) < (1 << 20) + 300_000 and [t for some in T._portions(texts) for t in some] == texts


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(9, 9), (3, 4), (4, 3)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    low = {x: x for x in nodes}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- pipeline ----

def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import corpus_pipeline as P
    from tests_llm_tables import toxic_tables
    docs, labels = toxic_tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "jaccard_join", "secret_scan", "pareto_mix", "bpe"]
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now.collect()
    clean = {r.doc_id for r in labels.collect() if not r.toxic}
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    ids = {r.doc_id for r in kept["toxicity"]}
    assert len(clean - ids) <= 0.03 * len(clean) and len(toxic & ids) <= 0.05 * len(toxic)
    texts = {r.doc_id: r.text for r in kept["toxicity"]}
    order = sorted(texts)
    _, low = brute_groups([texts[i] for i in order])
    assert sorted(r.doc_id for r in kept["jaccard_join"]) == [i for k, i in enumerate(order) if low[k] == k]
    assert len(kept["secret_scan"]) == len(kept["jaccard_join"]) and all(r.n_chars == len(r.text) for r in kept["secret_scan"] if r.text is not None)
    assert len(kept["bpe"]) == len(kept["pareto_mix"])
    again = P.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, kept["bpe"]))
