"""License scan by a positional rare-token index.

A template is a license notice as words; part of it is its mandatory key
phrase. The index keeps, for each template, the postings (word, offset) of the
words of its key phrase that are rarest over the whole corpus (highest IDF,
counted over all documents). A file's words are reduced to those rare words
with their positions; a template's postings turn each of them into a position
at which the phrase would start, the positions of its postings are intersected,
and each place left is verified word by word. So a common word such as "public"
or "by" is only ever looked at next to a rare one.

Everything runs row by row in Catalyst expressions: there is no shuffle but
the count of document frequencies (at most one row per template word and task).

Cases: null and empty texts have no words, no labels and score 0; a phrase
that stands several times counts each time; repeated rows give a row each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text whose A-Z are not lowered yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE_WORDS = 2


class Template(NamedTuple):
    label: str
    notice: str
    phrase: str


# Base phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license"),
    Template("apache", "apache license", "apache license"),
    Template("cc-by", "cc by", "cc by"),
    Template("mit", "mit license", "mit license"),
)
#: Notices with versions and further licenses, which the base phrases don't tell apart.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("epl-2.0", "eclipse public license version 2 0", "eclipse public license version 2 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("mit-notice", "released under the mit license", "under the mit license"),
    Template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """Words with A-Z lowered. lower() maps one sign outside A-Z to a letter of A-Z, the kelvin sign, so it is replaced first."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def _array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def document_frequency(words: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """Documents that hold each word of the key phrases; as many rows as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.phrase.split()})
    held = words.select(F.explode(F.array_intersect("words", _array(vocabulary))).alias("word"))
    return {w: 0 for w in vocabulary} | {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def rare_postings(templates: tuple[Template, ...], held: dict[str, int]) -> dict[Template, list[tuple[str, int]]]:
    """(word, offset in the phrase) of each template's rarest words."""
    index = {}
    for t in templates:
        first = {w: i for i, w in reversed(list(enumerate(t.phrase.split())))}
        index[t] = [(w, first[w]) for w in sorted(first, key=lambda w: (held[w], w))[:RARE_WORDS]]
    return index


def _is(word: str):
    return lambda hit: hit["w"] == word


def _back(offset: int):
    return lambda hit: hit["i"] - F.lit(offset)


def _places(t: Template, postings: list[tuple[str, int]]) -> Column:
    """Starts of the key phrase: postings intersected by relative position, then verified."""
    starts = None
    for word, offset in postings:
        of_word = F.transform(F.filter("hits", _is(word)), _back(offset))
        starts = of_word if starts is None else F.array_intersect(starts, of_word)
    phrase = t.phrase.split()
    return F.filter(starts, lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, F.lit(len(phrase))) == _array(phrase)))


def _agreement(t: Template, places: Column) -> Column:
    """The largest share of the notice's words that stand in their places around a verified phrase."""
    notice, phrase = t.notice.split(), t.phrase.split()
    lead = next(i for i in range(len(notice)) if notice[i:i + len(phrase)] == phrase)

    def share(s: Column) -> Column:
        hits = [F.coalesce((F.get("words", s + F.lit(k - lead)) == w).cast("int"), F.lit(0)) for k, w in enumerate(notice)]
        return sum(hits[1:], hits[0]) / F.lit(float(len(notice)))
    return F.coalesce(F.array_max(F.transform(places, share)), F.lit(0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Template, ...] = BASE,
         notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    words = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    templates = base + notices
    index = rare_postings(templates, document_frequency(words, templates))
    rare = sorted({w for postings in index.values() for w, _ in postings})
    marked = F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i"))))
    found = words.withColumn("hits", F.filter(marked, lambda h: h.isNotNull()))
    found = found.select("doc_id", "words", *(_places(t, index[t]).alias(f"at_{k}") for k, t in enumerate(templates)))

    def labels(some: tuple[Template, ...]) -> Column:
        held = [F.when(F.size(f"at_{templates.index(t)}") > 0, F.lit(t.label)) for t in some]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*held)))), ",")

    all_base = F.flatten(F.array(*(F.col(f"at_{k}") for k in range(len(base)))))
    found = found.withColumn("base_at", all_base).withColumn(
        "score", F.greatest(*(_agreement(t, F.col(f"at_{k}")) for k, t in enumerate(templates))))
    return found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("base_at").cast("long").alias("n_base"),
        F.array_min("base_at").cast("long").alias("first_word"), F.array_max("base_at").cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(templates).alias("labels"), "score")
