"""Secret scan with corpus-wide ownership frequency.

Candidates are matches of the base kinds (assign, access, hex) and of further
credential shapes. Every candidate's value is hashed, and over the whole corpus
each hash is counted by the distinct repositories and owners that hold it:
values that several owners or many repositories hold are widely copied examples,
values of one or two owners and at most LIVE_REPOSITORIES repositories that don't
look like placeholders are live. Base matches are always
reported; a match of a further shape is reported when its value is live.

Here a repository is a (source, lang) pair and an owner is a source; both are
parameters. A table of one or two sources has no value of several owners, so there
only the number of repositories tells a copied example from a live value; where
such a table has few languages too, every value but a placeholder is live.

Spark SQL has no function for match positions, so they come from the lengths of
the pieces between the matches (split) and of the matches themselves. All of it
is built-in expressions. The corpus-wide counts first reduce to distinct (hash,
owner, repository) with map-side combining, so a value copied into a third of
all rows is a few rows per task; no text is shuffled.

Cases: null and empty texts hold nothing; null owners and repositories count
as one owner named null; repeated rows give a row each; an empty table gives an
empty result; further columns are ignored or, in ``redacted``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadcast.llm.shared import cut, packed

# The base kinds in their order, with patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
BASE_KINDS = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32)}
#: Further shapes: signed web tokens, forge tokens, long mixed strings.
MORE_KINDS = {
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{20,}", 0, 24),
    "opaque": (r"[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24),
}
KINDS = {**BASE_KINDS, **MORE_KINDS}
OPAQUE_NEEDS = ("[a-z]", "[A-Z]", "[0-9]")
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|x{4,}|0{8,}|\*{4,}"
#: A value held by more owners than this is a copied example.
LIVE_OWNERS = 2
#: So is one that more repositories than this hold, whoever owns them.
LIVE_REPOSITORIES = 4


def _matches(text: Column, kind: str) -> Column:
    """array<struct<start, ord, end, kind, value>> of the leftmost non-overlapping matches that pass their least length."""
    pattern, group, least = KINDS[kind]
    order = list(KINDS).index(kind)
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value"))
    parts = F.filter(parts, lambda p: p["hit"].isNotNull())
    entry = "struct<start:int,ord:int,end:int,kind:string,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{entry}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.length(p["hit"])
        good = F.length(p["value"]) >= least
        if kind == "opaque":
            for need in OPAQUE_NEEDS:
                good = good & p["hit"].rlike(need)
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), p["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one.cast(f"array<{entry}>"))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{entry}>"))


def candidates(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """``keep`` and ``found``: all candidates of a row by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*map(F.col, keep), F.array_sort(F.concat(*(_matches(text, k) for k in KINDS))).alias("_found"))


def value_owners(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of rows (owner, repository, hashes), one row per distinct hash."""
    held = found.select("owner", "repository", F.explode("hashes").alias("hash")).distinct()
    per_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def _printed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kinds) -> Column:
    return F.filter("found", lambda s: s["kind"].isin(list(kinds)))


def _classified(docs: DataFrame, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with hashed candidates, (doc_id, text_key, found with live)); values don't leave the first expression."""
    plain = docs.select("doc_id", "text", F.coalesce(owner, F.lit("null")).alias("owner"), F.coalesce(repository, F.lit("null")).alias("repository"))
    rows = candidates(plain, "doc_id", "owner", "repository", "text")
    hashed = F.transform("_found", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"),
                                                      F.sha2(s["value"], 256).alias("hash"), s["value"].rlike(PLACEHOLDER).alias("placeholder")))
    key = F.when(F.size("_found") > 0, F.md5("text"))
    rows = cut(rows.select("doc_id", "owner", "repository", key.alias("text_key"), hashed.alias("found")), "secret-candidates")
    owners = cut(value_owners(rows.select("owner", "repository", F.transform("found", lambda s: s["hash"]).alias("hashes"))), "secret-owners")
    each = rows.select("doc_id", "text_key", F.explode("found").alias("s"))
    each = each.withColumn("hash", F.col("s.hash")).join(owners, "hash")
    live = (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES) & ~F.col("s.placeholder")
    spans = each.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct(
        "s.start", "s.ord", "s.end", "s.kind", live.alias("live")))).alias("spans"))
    return rows, cut(spans, "secret-spans")


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, lang): counts and spans, and how many values are live or copied."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    rows, spans = _classified(docs, owner, repository)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    full = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    base = _of_kind(BASE_KINDS)
    kept = F.filter(F.coalesce("spans", F.array()), lambda s: s["kind"].isin(list(BASE_KINDS)) | s["live"])
    return full.select(
        "doc_id", *(F.size(_of_kind([k])).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_printed(base), 256).alias("base_sha256"), _printed(kept).alias("spans"),
        F.size(F.filter(F.coalesce("spans", F.array()), lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(F.coalesce("spans", F.array()), lambda s: ~s["live"])).cast("long").alias("n_copied"))


def redacted(docs: DataFrame, live_mark: str = "[SECRET]", copied_mark: str = "[EXAMPLE]") -> DataFrame:
    """``docs`` with every reported span replaced: live values by one mark, copied or placeholder values of base kinds by another.

    Rows without candidates pass through; only rows with some meet the spans, by id and text.
    """
    columns = docs.columns
    rows = packed(docs).select("_row", "_row.doc_id", F.coalesce("_row.text", F.lit("")).alias("text"))
    any_kind = F.lit(False)
    for pattern, _, _ in KINDS.values():
        any_kind = any_kind | F.col("text").rlike(pattern)
    _, spans = _classified(docs, F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang")))
    spans = spans.select(F.col("doc_id").alias("_id"), "text_key", "spans")
    some = rows.where(any_kind).withColumn("_key", F.md5("text"))
    some = some.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("text_key")), "left")
    kept = F.filter(F.coalesce("spans", F.array()), lambda s: s["kind"].isin(list(BASE_KINDS)) | s["live"])

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["live"], F.lit(live_mark)).otherwise(F.lit(copied_mark))
        gap = F.col("text").substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] <= acc["at"], acc["out"]).otherwise(
            F.concat(acc["out"], gap, F.when(s["start"] >= acc["at"], mark).otherwise(F.lit("")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate(kept, start, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    fixed = F.when(F.size(kept) > 0, text).otherwise(F.col("_row.text"))
    some = some.select("_row", fixed.alias("text"))
    out = rows.where(~any_kind).select("_row", F.col("_row.text").alias("text")).unionByName(some)
    return out.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in columns))
