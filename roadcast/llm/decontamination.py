"""Benchmark decontamination by a prefix-filtered set join.

A window is WINDOW consecutive words of an item, or all words of an item that has fewer. A document contains a window
where its words stand consecutively; every word inside such a place is hit.

1. A window is the set of its shingles (SHINGLE words with their offsets). A place holds the window only if it holds all
   of them (containment 1), so of the shingles in a common order one is the necessary prefix. The order is by rarity:
   how often each shingle of any item occurs in all documents, counted in one scan whose counts are summed per task.
2. A second scan joins the documents' shingles with the windows' prefix shingles, by hash.
3. A match fixes where the window would start. Its length and that place must lie inside the document.
4. What is left is verified: the words of the place, joined by blanks, must have the window's SHA-256.

Only verified places leave that scan, with one row for each document, so what is shuffled grows with the contamination
and not with the corpus. A frequent shingle is never a prefix while its window has a rarer one; a passage that a third of
the documents share gives rows with those documents' own keys.

Everything is DataFrame expressions. The item's side is joined by broadcast in blocks of at most ``block_rows`` rows of
fixed width, a scan for each block, so its size is bounded whatever the benchmark's size.

Cases: null and empty texts have no words and no hits; an item without words has no windows; rows that share an item_id
are one item and rows with a null item_id none; documents are rows, so repeated rows give a row each; an empty table on
the documents' side gives an empty result, on the items' side no hits; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadcast.llm.shared import cut

WINDOW, SHINGLE = 10, 3
#: Rows of the item's side in one broadcast, some 80 bytes each.
BLOCK_ROWS = 500_000
#: All but words, in a text whose A-Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Join key of the one row that each document gives besides its matches.
DOCUMENT = 0


def _split(text: Column) -> Column:
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), GAP)


def with_words(rows: DataFrame, text: str) -> DataFrame:
    """w: pieces between gaps; lo, hi: the words are w[lo:hi]. Only the first and last piece can be empty."""
    return (rows.withColumn("w", _split(F.col(text)))
            .withColumn("lo", (F.get("w", F.lit(0)) == "").cast("int"))
            .withColumn("hi", F.greatest(F.size("w") - (F.element_at("w", -1) == "").cast("int"), F.col("lo"))))


def _shingle(at: Column, k: int) -> Column:
    """Hash of the k words from ``at`` on; null where they would pass the end."""
    words = [F.get("w", at + j) for j in range(k)]
    return F.when(at + k <= F.col("hi"), F.xxhash64(F.lit(k), *words))


def _shingles_of(k: int):
    return lambda at: _shingle(at, k)


def _digest(at: Column, n: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(" ", F.slice("w", at + 1, n)).cast("binary"), 256))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window, len, k, shingles): each place of each item; shingles has one hash for each offset."""
    rows = with_words(items.select(F.col("item_id"), F.col("text")).where("item_id IS NOT NULL"), "text").where("hi > lo")
    rows = rows.withColumn("len", F.least(F.col("hi") - F.col("lo"), F.lit(WINDOW))).withColumn("k", F.least("len", F.lit(SHINGLE)))
    rows = rows.withColumn("at", F.explode(F.expr("sequence(lo, hi - len)")))
    hashes = F.lit(None)
    for k in range(1, SHINGLE + 1):
        hashes = F.when(F.col("k") == k, F.transform(F.expr("sequence(at, at + len - k)"), _shingles_of(k))).otherwise(hashes)
    return rows.select("item_id", _digest(F.col("at"), F.col("len")).alias("window"), "len", "k", hashes.alias("shingles"))


def _places(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each word's place ``at`` with the hash h of the shingle there, and one at lo - 1 that stands for the document."""
    rows = docs.withColumn("at", F.explode(F.expr("sequence(lo - 1, hi - 1)")))
    own = F.col("at") < F.col("lo")
    if len(lengths) == 1:
        return rows.withColumn("h", F.when(own, F.lit(DOCUMENT).cast("long")).otherwise(_shingle(F.col("at"), lengths[0])))
    several = F.array_compact(F.array(*(_shingle(F.col("at"), k) for k in lengths)))
    return rows.withColumn("h", F.explode(F.when(own, F.array(F.lit(DOCUMENT).cast("long"))).otherwise(several)))


def _blocks(rows: DataFrame, key: str, block_rows: int) -> list[DataFrame]:
    """``rows`` in parts of about block_rows, by hash of the key."""
    n = -(-rows.count() // block_rows) or 1
    return [rows.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(n)) == b) for b in range(n)]


def prefixes(docs: DataFrame, windows: DataFrame, lengths: list[int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(h, offset, len, window): each window's rarest shingle in ``docs``."""
    each = windows.dropDuplicates(["window"]).select("window", "len", F.posexplode("shingles").alias("offset", "h"))
    each = cut(each, "shingles")
    counts = []
    for some in _blocks(each.select("h").distinct(), "h", block_rows):
        counts.append(_places(docs, lengths).select("h").join(F.broadcast(some), "h").groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    counted = cut(reduce(DataFrame.unionByName, counts), "rarity")
    ranked = each.join(counted, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("window").agg(F.min(F.struct("n", "h", "offset", "len")).alias("p"))
    return rarest.select("p.h", "p.offset", "p.len", "window")


def occurrences(docs: DataFrame, items: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, n_words, start, len, window), (window, item_id)).

    The first has a row for each place of a window (start counts words from 0), and one with a null window for each
    document. text_hash tells rows with one doc_id and different texts apart.
    """
    words = with_words(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), "text").drop("text")
    windows = cut(item_windows(items), "windows")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect()) or [SHINGLE]
    rarest = cut(prefixes(words, windows, lengths, block_rows), "prefixes")
    document = F.lit(DOCUMENT).cast("long")
    found = []
    for b, some in enumerate(_blocks(rarest, "window", block_rows)):
        own = rarest.sparkSession.range(1 if b == 0 else 0).select(
            document.alias("h"), F.lit(0).alias("offset"), F.lit(0).alias("len"), F.lit(None).cast("binary").alias("window"))
        hits = _places(words, lengths).join(F.broadcast(some.unionByName(own)), "h")
        start = F.col("at") - F.col("offset")
        inside = (start >= F.col("lo")) & (start + F.col("len") <= F.col("hi"))
        same = F.when(inside, _digest(start, F.col("len")) == F.col("window"))
        one = F.col("at") < F.col("lo")
        hits = hits.where(F.when(F.col("window").isNull(), one).otherwise(~one & same))
        found.append(hits.select("doc_id", "text_hash", (F.col("hi") - F.col("lo")).cast("long").alias("n_words"),
                                 F.when(~one, start - F.col("lo")).alias("start"), "len", "window"))
    return cut(reduce(DataFrame.unionByName, found), "places"), windows.select("window", "item_id").distinct()


def _covered(spans: str) -> Column:
    """Words under spans (start, len), each once."""
    return F.expr(f"""aggregate(array_sort({spans}), named_struct('n', 0L, 'end', 0L),
        (a, s) -> named_struct('n', a.n + greatest(0L, s.start + s.len - greatest(a.end, bigint(s.start))),
                               'end', greatest(a.end, bigint(s.start + s.len))), a -> a.n)""")


def report(docs: DataFrame, items: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) for each row of docs; items: ids in the order of their text."""
    places, members = occurrences(docs, items, block_rows)
    members = cut(members, "members")
    key = ["doc_id", "text_hash"]
    hits = places.where("window IS NOT NULL")
    cover = hits.groupBy(*key).agg(_covered("collect_set(struct(start, len))").alias("n_hit"))
    held = hits.select(*key, "window").distinct().join(members, "window").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    held = held.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = cover.join(held, [cover[c].eqNullSafe(held[c]) for c in key]).select(
        cover["doc_id"].alias("_id"), cover["text_hash"].alias("_hash"), "n_hit", "items")
    rows = places.where("window IS NULL").select(*key, "n_words")
    rows = rows.join(found, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_hash"] == F.col("_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                       listed.alias("items"), (n_hit > 0).alias("contaminated"))
