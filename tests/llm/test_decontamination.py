"""Decontamination against a plain search for every window."""

import random
import re

import pytest

from roadcast.llm import decontamination

DOCS = "doc_id long, text string, item_id long, window string"
ITEMS = "item_id long, text string, n_words int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, text, _ in items:
        w = words(text)
        n = min(10, len(w))
        if i is not None and n:
            for s in range(len(w) - n + 1):
                windows.setdefault(tuple(w[s:s + n]), set()).add(i)
    out = []
    for d, text, *_ in docs:
        w, hit, held = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                ids = windows.get(tuple(w[s:s + n]))
                if ids:
                    hit |= set(range(s, s + n))
                    held |= ids
        out.append((d, len(w), len(hit), len(held), ",".join(sorted(map(str, held))), bool(hit)))
    return out


def tables(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "a", "to", "école", "straße", "x1", "mañana", "b2", "İz", "ÉCOLE", "K9"] + [f"w{k}" for k in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 30]))), 0) for i in range(40)]
    items += [(100, "the the the the the the the the the the the the the", 0), (7, "said again with another text of the same id today ok", 0),
              (200, None, 0), (201, " ... ", 0), (None, "the of", 0), (9, items[9][1], 0), (11, items[9][1], 0)]
    docs = []
    for d in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 8, 60, 300]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randint(0, len(text)):0] = rng.choice(items[:40])[1].split()
        docs.append((d, rng.choice([" ", ", ", "\n- "]).join(text).replace("the", rng.choice(["the", "The", "THE"])), 1, ""))
    docs += [(500, "the " * 40, 0, ""), (501, None, 0, ""), (502, "", 0, ""), (503, "!!", 0, ""), docs[3], docs[3], (3, "other text", 0, ""), (None, items[9][1], 0, "")]
    return docs, items


@pytest.mark.parametrize("seed,block_rows", [(1, 500_000), (2, 30)])
def test_report_equals_brute_force(spark, seed, block_rows):
    docs, items = tables(seed)
    found = decontamination.report(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), block_rows)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in found.collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r))
    assert order(got) == order(brute(docs, items))
    assert sum(r[5] for r in got) > 20


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d", 0, "")], DOCS), spark.createDataFrame([(1, "a b c", 0)], ITEMS)
    assert decontamination.report(docs.limit(0), items).collect() == []
    (row,) = decontamination.report(docs, items.limit(0)).collect()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (4, 0, False)


def test_prefix_is_the_rarest_shingle(spark):
    docs = spark.createDataFrame([(k, "a b c d e f g h i j", 0, "") for k in range(5)] + [(9, "a b c d e f g", 0, "")] * 3, DOCS)
    items = spark.createDataFrame([(1, "a b c d e f g h i j", 0)], ITEMS)
    held = decontamination.with_words(docs, "text")
    (row,) = decontamination.prefixes(held, decontamination.item_windows(items), [3]).collect()
    assert row["len"] == 10 and row["offset"] >= 5  # shingles that reach h stand in five documents, the others in eight


def test_main_path_is_native(spark):
    docs, items = tables(3)
    plan = decontamination.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
