"""BPE encoding and decoding of whole texts in batched numpy merge rounds.

A vocabulary file of the ``tokenizers`` JSON form is read on the driver and
broadcast (its size is that of the vocabulary, whatever the corpus). A task
splits texts into words and encodes the words it hasn't met yet all at once:
their symbols lie in one flat array, a round looks up every adjacent pair in
the sorted pair keys by binary search, takes the lowest rank of each word, and
merges all places of that pair in the word from left to right. Words without a
known pair leave the array, so a round costs the words still at work, and the
number of rounds is the largest number of merges of one word.

The words' ids are kept per task in a table of bounded size, which saves work
on repeated words and changes no result.

Handled as in such files: special tokens found in the raw text, NFC, white
space, lower case per character (no final sigma), the pre-tokenizer's pattern,
byte-level symbols, the end-of-word suffix; without a decoder in the file
tokens are joined by a space.

Cases: null and empty texts have no ids and decode to an empty text; one word
may be as long as a text; repeated rows give a row each; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words that a task keeps before it starts a new table, and rows of one batch.
KEPT_WORDS = 200_000
# Letters that Unicode 16 added to version 15.1 (of Python's unicodedata), and lower case that 16 and 17 added.
# Files of this kind are applied with these; the regex module is ahead of them by later letters.
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
NO_PAIR = np.iinfo(np.int64).max


_LOWERED_LATER = frozenset(map(chr, LATER_LOWER))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """A parsed vocabulary; small, picklable, the same on every worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.size = size
        steps = spec["normalizer"]["normalizers"]
        self.nfc, self.lower = (any(s["type"] == kind for s in steps) for kind in ("NFC", "Lowercase"))
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], dtype=np.int64)
        self.last = np.array([ids[s + end] for s in symbols], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self._compiled = None

    def __getstate__(self):
        return self.__dict__ | {"_compiled": None}

    def _patterns(self):
        """Special tokens; the words' pattern; letters that only the regex module knows yet; the pattern without them."""
        if self._compiled is None:
            special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
            known = {c for lo, hi in LATER_LETTERS for c in range(lo, hi + 1)}
            early = [c for c in map(ord, regex.findall(r"\p{L}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))))
                     if unicodedata.category(chr(c)) == "Cn" and c not in known]
            spans: list[list[int]] = []
            for c in early:
                if spans and spans[-1][1] == c - 1:
                    spans[-1][1] = c
                else:
                    spans.append([c, c])
            letters = r"[\p{L}--[" + "".join(rf"\U{lo:08X}-\U{hi:08X}" for lo, hi in spans) + "]]"
            others = rf"(?:[^\s\p{{L}}\p{{N}}]|[{''.join(rf'\U{lo:08X}-\U{hi:08X}' for lo, hi in spans)}])"
            slow = self.pattern.replace(r"[\p{L}]", letters).replace(r"[^\s\p{L}\p{N}]", others) if spans else self.pattern
            self._compiled = special, regex.compile(self.pattern, regex.V1), frozenset(map(chr, early)), regex.compile(slow, regex.V1)
        return self._compiled

    def words(self, text: str) -> list[str | int]:
        """Normalised words in order; a special token is its id."""
        special, usual, early, slow = self._patterns()
        parts = special.split(text) if special and any(s in text for s in self.special) else [text]
        out: list[str | int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
                continue
            if self.nfc and not part.isascii():
                part = unicodedata.normalize("NFC", part)
            plain = part.isascii()
            if self.lower:
                if not plain and not _LOWERED_LATER.isdisjoint(part):
                    part = part.translate(LATER_LOWER)
                part = part.replace("Σ", "σ").lower()
            out += (usual if plain or early.isdisjoint(part) else slow).findall(part)
        return out

    # ---- merge rounds ----

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, all words merged together."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(b) for b in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(lengths)
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        while len(sym):
            pair = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.full(len(sym), NO_PAIR)
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            each = np.repeat(best, sizes)
            at_work = each != NO_PAIR
            chosen = at_work & (rank == each)
            place = np.flatnonzero(chosen)
            # of overlapping places of one pair (a a a) every second one merges, from the left
            if len(place) > 1:
                run = np.flatnonzero(np.r_[True, np.diff(place) != 1])
                within = np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))
                place = place[within % 2 == 0]
            sym[place] = self.made[at[place]]
            stay = np.ones(len(sym), dtype=bool)
            stay[place + 1] = False
            done_sym.append(sym[~at_work])
            done_word.append(word[~at_work])
            stay &= at_work
            sym, word = sym[stay], word[stay]
        if not done_sym:
            return []
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        sym = sym[np.argsort(word, kind="stable")].astype("<u4")
        cuts = np.cumsum(np.bincount(word, minlength=len(words)))[:-1]
        return np.split(sym, cuts)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


class Encoder:
    """Encodes texts with one table of words met so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.met = vocabulary, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.vocabulary.words(t) for t in texts]
        if len(self.met) > KEPT_WORDS:
            self.met = {}
        met = self.met
        new = [w for w in dict.fromkeys(w for words in split for w in words) if w not in met]
        plain = [w for w in new if isinstance(w, str)]
        met.update((w, np.uint32(w).astype("<u4").tobytes()) for w in new if not isinstance(w, str))
        met.update(zip(plain, (ids.tobytes() for ids in self.vocabulary.encode_words(plain))))
        return [b"".join(map(met.__getitem__, words)) for words in split]


def _in_portions(texts: list[str], limit: int = 2 << 20) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; ids as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            keys, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            at = 0
            for some in _in_portions(texts):
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(some)), pa.array(encoder.encode(some), pa.binary())], ["doc_id", "ids"])
                at += len(some)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows (doc_id, ids)."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.slice(lo, 1000)
                texts = [vocabulary.decode(np.frombuffer(x.as_py(), dtype="<u4")) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.large_string()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: both directions in one pass, by one Python worker."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for at in range(0, len(b), 500):
                part = [t or "" for t in texts.slice(at, 500).to_pylist()]
                done = 0
                for some in _in_portions(part):
                    ids = encoder.encode(some)
                    back = [shared.value.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
                    yield pa.RecordBatch.from_arrays([keys.slice(at + done, len(some)), pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])
                    done += len(some)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
