"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Kernel: words, with a mark at their start, are compared by their subsequences
of four letters, each weighted LAMBDA ** span for the span it covers (at most
SPAN characters), so gaps and inserted characters lower a similarity instead
of voiding it; the kernel is normalised, and its POWER is taken (a product of kernels is one), where
similarities below FLOOR count as 0. Common digit and sign spellings are read as letters, runs of single letters
("i d i o t") also count as one word, and words longer than WINDOW letters are
compared window by window.

Landmarks are words of labelled documents: those most typical of toxic ones,
each unlike the others, and some common words of clean ones. A sentence's
features are its best similarity to each landmark, mapped by the inverse
square root of the landmarks' kernel matrix (Nystroem). The machine is trained
on labelled sentences: a clean document's sentences are clean; of a toxic
document's, the worst is toxic and so are those on the toxic side, chosen anew
in each round (the first time: the most similar to a landmark). A document's score is a logistic function,
fitted to the same labels, of the margins of its WORST worst sentences and of
its length, as long texts meet more words that look like an insult by chance.

The fit uses a bounded sample: ``DOCS_PER_CLASS`` documents of each label, the
first by a hash of the id, of which ``SENTENCES`` sentences each reach the
driver. Scoring covers every document and its whole text.

Cases: null and empty texts have no sentence and score as a document without
toxic words; without labelled documents of both classes every score is 0; a
repeated label row counts once, contradicting ones count as toxic; repeated
rows give a row each; an empty table gives an empty result; further columns are ignored or kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from roadcast.llm.shared import packed, unpacked

LAMBDA, LETTERS, SPAN, WINDOW, STRIDE = 0.7, 4, 7, 24, 12
FLOOR, POWER = 0.4, 3
LANDMARKS, CLEAN_LANDMARKS, CANDIDATES, UNLIKE = 72, 8, 1500, 0.7
DOCS_PER_CLASS, SENTENCES, ROUNDS, WORST = 4000, 6, 4, 3
KEPT_WORDS = 200_000
FOLDS = 5

# Signs read as letters.
SPELLINGS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\n\r]+")
_SPELT = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")


def _letter_codes() -> np.ndarray:
    """Code 1..26 of a..z, 27..30 of other letters, 0 of what only makes a gap, for code points below 0x250."""
    codes = np.zeros(0x250, dtype=np.int32)
    for c in range(0x250):
        ch = SPELLINGS.get(chr(c), chr(c).lower()[0])
        codes[c] = ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % 4 if ch.isalpha() else 0
    return codes


_CODES, _START = _letter_codes(), 31
_STEPS = list(combinations(range(1, SPAN), LETTERS - 1))
FEATURES = 32 ** LETTERS


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all windows of all words in one flat array, each after a start mark and before SPAN zeros; the windows' starts and words."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        if len(w) <= WINDOW:
            pieces.append(w)
            owner.append(i)
        else:
            starts = range(0, len(w) - STRIDE, STRIDE)
            pieces += [w[s:s + WINDOW] for s in starts]
            owner += [i] * len(starts)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = np.where(points < 0x250, _CODES[np.minimum(points, 0x24F)], 27 + points % 4)
    starts = np.cumsum(lengths + 1 + SPAN) - (lengths + 1 + SPAN)
    flat = np.zeros(int((lengths + 1 + SPAN).sum()) + SPAN, dtype=np.int32)
    flat[starts] = _START
    flat[np.arange(len(points)) + np.repeat(starts + 1 - (np.cumsum(lengths) - lengths), lengths)] = codes
    return flat, starts, np.array(owner, dtype=np.int64)


def subsequences(flat: np.ndarray):
    """For each way to step: the features at all places (0 where a letter is missing) and their weight."""
    n = len(flat) - SPAN
    letters = [flat[k:k + n] for k in range(SPAN)]
    for step in _STEPS:
        feature, valid = letters[0], letters[0] > 0
        for k in step:
            feature, valid = feature * 32 + letters[k], valid & (letters[k] > 0)
        yield np.where(valid, feature, 0), LAMBDA ** (step[-1] + 1)


def features(flat: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) summed by row and feature; row_of: the row of each place, or -1."""
    keys, weights = [], []
    for feature, weight in subsequences(flat):
        at = np.flatnonzero((feature > 0) & (row_of >= 0))
        keys.append(row_of[at] * FEATURES + feature[at])
        weights.append(np.full(len(at), weight))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key // FEATURES, key % FEATURES, np.bincount(back, weights=np.concatenate(weights), minlength=len(key))


def _rows(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(flat) - SPAN
    return np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))


def _unit_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The features that words (of one window each) have, and their unit rows over these as (row, column, weight)."""
    flat, starts, _ = word_codes([w[:WINDOW] for w in words])
    row, feature, weight = features(flat, _rows(flat, starts))
    used, column = np.unique(feature, return_inverse=True)
    norm = np.maximum(np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(words))), 1e-12)
    return used, row, column, weight / norm[row]


def normalised(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features that words (of one window each) have, and their unit rows over these."""
    used, row, column, weight = _unit_rows(words)
    out = np.zeros((len(words), len(used)))
    out[row, column] = weight
    return used, out


def unlike(words: list[str], count: int) -> list[int]:
    """Numbers of the first ``count`` words that are each less than UNLIKE similar to those taken before; no dense matrix of all words."""
    used, row, column, weight = _unit_rows(words)
    usable = np.bincount(row, minlength=len(words)) > 0
    nearest, one, taken = np.zeros(len(words)), np.zeros(len(used)), []
    for i in range(len(words)):
        if len(taken) == count:
            break
        if usable[i] and nearest[i] < UNLIKE:
            taken.append(i)
            own = slice(*np.searchsorted(row, [i, i + 1]))
            one[column[own]] = weight[own]
            nearest = np.maximum(nearest, np.bincount(row, weights=weight * one[column], minlength=len(words)))
            one[column[own]] = 0
    return taken


def _sharpened(similarity: np.ndarray) -> np.ndarray:
    return np.where(similarity < FLOOR, 0.0, similarity ** POWER)


class Model:
    """Landmarks, their table of feature weights and the machine."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        used, unit = normalised(landmarks)
        self.used, self.table = used, unit.T.copy()
        gram = unit @ unit.T
        gram = _sharpened(gram)
        values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(len(gram)))
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        self.beta, self.bias, self.final = np.zeros(len(landmarks)), 0.0, np.zeros(WORST + 2)
        self._lookup = None

    def __getstate__(self):
        return self.__dict__ | {"_lookup": None}

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Per feature: its row in the table or -1, and its largest weight over the landmarks."""
        if self._lookup is None:
            index, most = np.full(FEATURES, -1, dtype=np.int32), np.zeros(FEATURES, dtype=np.float32)
            index[self.used] = np.arange(len(self.used))
            most[self.used] = self.table.max(axis=1, initial=0)
            self._lookup = index, most
        return self._lookup

    def similar(self, words: list[str]) -> dict[str, np.ndarray]:
        """Words with a similarity of FLOOR or more to some landmark, and all their similarities."""
        out: dict[str, np.ndarray] = {}
        for lo in range(0, len(words), 2000):
            out.update(self._similar(words[lo:lo + 2000]))
        return out

    def _similar(self, words: list[str]) -> dict[str, np.ndarray]:
        index, most = self.lookup()
        flat, starts, owner = word_codes(words)
        n = len(flat) - SPAN
        # upper bound of every similarity: features' largest landmark weights over a lower bound of the word's norm
        bound, least = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
        for feature, weight in subsequences(flat):
            bound += most[feature] * np.float32(weight)
            least += (feature > 0) * np.float32(weight * weight)
        bound, least = np.add.reduceat(bound, starts), np.sqrt(np.add.reduceat(least, starts))
        rows = np.flatnonzero((least > 0) & (bound >= 0.999 * FLOOR * least))
        out: dict[str, np.ndarray] = {}
        cuts = np.r_[starts, n]
        for lo in range(0, len(rows), 300):
            for word, sims in self._exact([words[i] for i in owner[rows[lo:lo + 300]]], flat, cuts, rows[lo:lo + 300], index):
                out[word] = np.maximum(out[word], sims) if word in out else sims
        return out

    def _exact(self, words: list[str], flat: np.ndarray, cuts: np.ndarray, rows: np.ndarray, index: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """(word, similarities) of the windows ``rows`` that have any."""
        part = np.concatenate([flat[cuts[i]:cuts[i + 1]] for i in rows] + [np.zeros(SPAN, dtype=np.int32)])
        sizes = np.diff(cuts)[rows]
        row, feature, weight = features(part, np.repeat(np.arange(len(rows)), sizes))
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(rows)))
        at = index[feature]
        known = np.flatnonzero(at >= 0)
        sims = np.zeros((len(rows), len(self.landmarks)))
        if len(known):
            first = np.flatnonzero(np.r_[True, np.diff(row[known]) != 0])
            sims[row[known][first]] = np.add.reduceat(self.table[at[known]] * weight[known][:, None], first, axis=0)
        sims /= norm[:, None]
        sims = _sharpened(sims).astype(np.float32)
        return [(words[i], sims[i].copy()) for i in np.flatnonzero(sims.any(axis=1))]

    def summary(self, margins: np.ndarray, n_chars: int) -> np.ndarray:
        """The worst margins (that of a sentence without any similar word, where there are fewer), the length, 1."""
        top = np.sort(np.r_[margins, np.full(WORST, self.bias)])[::-1][:WORST]
        return np.r_[top, np.log10(1 + n_chars), 1.0]

    def probability(self, margins: np.ndarray, n_chars: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(margins, n_chars) @ self.final, -30, 30))))


class Scorer:
    """Sentences and margins of texts, with a bounded table of words met so far."""

    def __init__(self, model: Model):
        self.model, self.met, self.near = model, set(), {}

    def sentences(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each text the landmark similarities of its sentences that have any."""
        lowered = [t.lower() for t in texts]
        spelt = [[re.sub(r"\s", "", m) for m in _SPELT.findall(t)] if " " in t else [] for t in lowered]
        sets = [set(t.split()).union(s) for t, s in zip(lowered, spelt)]
        if len(self.met) > KEPT_WORDS:
            self.met, self.near = set(), {}
        new = list(set().union(*sets) - self.met) if sets else []
        self.near.update(self.model.similar(new))
        self.met.update(new)
        near, out = self.near, []
        for t, s, words in zip(lowered, spelt, sets):
            if near.keys().isdisjoint(words):
                out.append([])
                continue
            found = []
            for sentence in _SENTENCE.split(t):
                hits = [near[w] for w in sentence.split() if w in near]
                if hits:
                    found.append(np.max(hits, axis=0))
            found += [near[w] for w in s if w in near]
            out.append(found)
        return out

    def scores(self, texts: list[str]) -> list[float]:
        model, none = self.model, np.zeros(0)
        return [model.probability(np.array(found) @ model.beta + model.bias if found else none, len(t))
                for t, found in zip(texts, self.sentences(texts))]


def _portions(values: list, limit: int = 1 << 20) -> Iterator[list[str]]:
    some, size = [], 0
    for v in values:
        some.append(v if isinstance(v, str) else "")
        size += len(some[-1])
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


# ---- fitting ----

def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most DOCS_PER_CLASS documents of each label, none held out (their ids are broadcast), and all labels' counts."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    ids = [marked.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(DOCS_PER_CLASS) for c in (0, 1)]
    ids = ids[0].unionByName(ids[1])
    per_class = {c: 0 for c in (0, 1)} | {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), per_class


def _landmarks(sample: DataFrame) -> list[str]:
    """Words typical of toxic documents, unlike each other, then common words of clean ones."""
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}@$]+"))).alias("word"))
    words = words.where(F.length("word").between(3, WINDOW))
    toxic, clean = F.sum("toxic"), F.count(F.lit(1)) - F.sum("toxic")
    counts = words.groupBy("word").agg(toxic.alias("t"), clean.alias("c"))
    odds = F.col("t") * F.log((F.col("t") + 0.5) / (F.col("c") + 0.5))
    typical = counts.where((F.col("t") >= 3) & (F.col("t") >= 4 * F.col("c"))).orderBy(odds.desc(), "word").limit(CANDIDATES)
    common = counts.orderBy(F.col("c").desc(), "word").limit(CLEAN_LANDMARKS)
    words_ = [r["word"] for r in typical.collect()]
    if not words_:
        return []
    chosen = [words_[i] for i in unlike(words_, LANDMARKS)]
    return chosen + [r["word"] for r in common.collect() if r["word"] not in chosen] if chosen else []


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights and bias (last) of the primal support vector machine with squared hinge loss, by Newton steps."""
    z = np.c_[x, np.ones(len(x), dtype=x.dtype)]
    ridge = penalty * weight.sum() * np.eye(z.shape[1])
    ridge[-1, -1] *= 1e-3
    w = np.zeros(z.shape[1])
    active = np.ones(len(z), dtype=bool)
    for _ in range(40):
        some = z[active].astype(np.float64)
        a = some * weight[active][:, None]
        w = np.linalg.solve(ridge + a.T @ some, a.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of P(y = 1 | z) with a light ridge, by damped Newton steps; weight: how many documents a row stands for."""
    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, (1 - 2 * y) * (z @ w))).sum() + 0.05 * (w @ w))

    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (weight * (p - y)) + 0.1 * w)
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the labelled documents that aren't held out."""
    sample, per_class = _sample(docs, labels)
    landmarks = _landmarks(sample)
    if not landmarks:
        return None
    model = Model(landmarks)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worst(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            at = 0
            for some in _portions(b["text"].tolist()):
                rows = []
                for found in scorer.sentences(some):
                    found = sorted(found, key=lambda v: (-v.max(), tuple(v)))[:SENTENCES]
                    rows.append(np.array(found, dtype="<f4").tobytes())
                yield pd.DataFrame({"toxic": b["toxic"].to_numpy()[at:at + len(some)], "n": list(map(len, some)), "sims": rows})
                at += len(some)

    rows = sorted((int(r["toxic"]), int(r["n"]), bytes(r["sims"])) for r in sample.mapInPandas(worst, "toxic int, n long, sims binary").collect())
    label = np.array([t for t, _, _ in rows])
    if len(set(label.tolist())) < 2:
        return None
    plain = [np.frombuffer(s, dtype="<f4").reshape(-1, len(landmarks)) for _, _, s in rows]
    root = model.root.astype(np.float32)
    bags = [(b if len(b) else np.zeros((1, len(landmarks)), dtype=np.float32)) @ root for b in plain]
    clean = np.concatenate([b for b, t in zip(bags, label) if not t])
    toxic = np.concatenate([b for b, t in zip(bags, label) if t])
    sizes = np.array([len(b) for b, t in zip(bags, label) if t])
    first = np.cumsum(sizes) - sizes
    # a toxic document's sentences count as toxic while they look so; its worst one always does
    strength, w = np.concatenate([(b if len(b) else np.zeros((1, len(landmarks)))).max(axis=1) for b, t in zip(plain, label) if t]) - 0.5, None
    for _ in range(ROUNDS):
        chosen = (strength > 0) | (strength == np.repeat(np.maximum.reduceat(strength, first), sizes))
        x = np.concatenate([clean, toxic[chosen]])
        y = np.r_[-np.ones(len(clean)), np.ones(int(chosen.sum()))]
        w = _machine(x, y, np.where(y > 0, np.sqrt(len(clean) / chosen.sum()), 1.0))
        strength = toxic @ w[:-1] + w[-1]
    model.beta, model.bias = model.root @ w[:-1], float(w[-1])
    z = np.array([model.summary(b @ model.beta + model.bias, n) for b, (_, n, _) in zip(plain, rows)])
    stands = np.array([per_class[c] / max(1, (label == c).sum()) for c in (0, 1)])
    model.final = _logistic(z, label.astype(float), stands[label])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def score_column(spark, model: Model | None, text: str = "text") -> Column:
    """The score of a text column: 0 without a model."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield pd.Series([s for some in _portions(b.tolist()) for s in scorer.scores(some)], dtype="float64")

    return score(F.col(text))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text").withColumn("score", score_column(docs.sparkSession, model))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns."""
    rows = packed(docs).withColumn("_text", F.col("_row.text"))
    rows = rows.withColumn("_score", score_column(docs.sparkSession, model, "_text"))
    return unpacked(rows.where(F.col("_score") < 0.5))
