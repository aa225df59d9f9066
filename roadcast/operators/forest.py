"""Random forests grown in lockstep on counted rows (VA8, VA9, VA17, EX14).

A library forest bags and visits every training row for every tree and level. Rows with the same features and class are
alike to every split, so they are counted first (one partial aggregate over the training rows) and a forest grows on the
counts: its time follows the number of distinct rows. Where nearly all rows are distinct, that table is as long as the
input and its scans are dealt to all tasks; nothing is sampled or capped.

* Bagging: a row takes part in a tree Poisson(1) times, so n equal rows do Poisson(n) times. The draws of a counted row
  come from a generator of its own, keyed by a hash of its features and class, and are written beside it: they don't depend on
  partitions, and a retried task reads the same.
* All trees grow together, one job a level: histograms of (node, drawn feature, bin, class) are added up per tree, the
  best split of a node is chosen where its histogram is, the driver gets one row a tree and node.
* Settings are those of MLlib's classifier: ceil(sqrt(features)) drawn at each node (all for a single tree), Gini gain
  above 0, class weights on the bag's counts, two leaves of the same class merged into their parent, a tree's vote the
  class shares of its leaf. Histograms hold whole numbers, so sums don't depend on their order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from roadcast.operators.features import encoder_pipeline, numeric_cuts, with_bins
from roadcast.operators.sizing import materialize

ROWS_A_TASK = 2048
HISTOGRAM = "tree int, node int, histogram binary"
KINDS = [pa.int32()] * 4 + [pa.float64(), pa.binary(), pa.binary()]
NAMES = ["tree", "node", "feature", "cut", "gain", "counts", "left_counts"]
SPLIT = "tree int, node int, feature int, cut int, gain double, counts binary, left_counts binary"


class Trees:
    """Node 1 is a root, 2 n and 2 n + 1 are the children of n; counts are the bag's rows of each class."""

    def __init__(self, trees: int, depth: int, widths: list[int], weights: list[float], seed: int):
        self.depth, self.widths, self.weights, self.seed = depth, widths, np.array(weights), seed
        shape = (trees, 2 << depth)
        self.feature = np.full(shape, -1, dtype=np.int32)
        self.cut = np.zeros(shape, dtype=np.uint8)
        self.gain = np.zeros(shape)
        self.counts = np.zeros((*shape, len(weights)))
        self.drawn = len(widths) if trees == 1 else int(np.ceil(np.sqrt(len(widths))))

    def nodes(self, tree: int, bins: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's node, and whether it is ``levels`` below the root."""
        at, rows = np.ones(len(bins), dtype=np.int64), np.arange(len(bins))
        inner = np.ones(len(bins), dtype=bool)
        for _ in range(levels):
            f = self.feature[tree][at]
            inner = f >= 0
            at = np.where(inner, 2 * at + (bins[rows, np.maximum(f, 0)] > self.cut[tree][at]), at)
        return at, inner

    def features_of(self, tree: int, level: int) -> np.ndarray:
        """(nodes of a level, drawn): the features that each node may split on."""
        score = np.random.default_rng([self.seed, tree, level]).random((1 << level, len(self.widths)))
        return np.argsort(score, axis=1)[:, :self.drawn]

    def histogram(self, tree: int, level: int, bins: np.ndarray, label: np.ndarray, bag: np.ndarray) -> np.ndarray:
        """(node, drawn feature, bin, class) sums of ``bag``."""
        at, inner = self.nodes(tree, bins, level)
        take = np.flatnonzero(inner & (bag > 0))
        node, classes, most = at[take] - (1 << level), len(self.weights), max(self.widths)
        features, shape = self.features_of(tree, level), (1 << level, self.drawn, most, classes)
        out = np.zeros(int(np.prod(shape)))
        if len(take):
            start = node * (self.drawn * most * classes) + label[take]
            for j in range(self.drawn):
                where = start + (j * most + bins[take, features[node, j]].astype(np.int64)) * classes
                out += np.bincount(where, weights=bag[take], minlength=len(out))
        return out.reshape(shape)

    def splits(self, tree: int, level: int, nodes: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Rows of SPLIT; feature -1 if none has a gain."""
        features = self.features_of(tree, level)[nodes - (1 << level)]
        whole, left = h[:, :1].sum(axis=2), np.cumsum(h, axis=2)  # whole: (nodes, 1, classes)
        right = whole[:, :, None] - left
        allowed = (left.sum(axis=3) > 0) & (right.sum(axis=3) > 0)
        squares = lambda x: ((x * self.weights) ** 2).sum(axis=-1) / np.maximum((x * self.weights).sum(axis=-1), 1e-300)
        gain = (squares(left) + squares(right) - squares(whole)[:, :, None]) / np.maximum((whole * self.weights).sum(axis=-1), 1e-300)[:, :, None]
        gain = np.where(allowed, gain, -np.inf).reshape(len(h), -1)
        out, most = [], h.shape[2]
        for i, k in enumerate(np.argmax(gain, axis=1)):
            j, cut = divmod(int(k), most)
            found = gain[i, k] > 1e-12
            out.append((tree, int(nodes[i]), int(features[i, j]) if found else -1, cut if found else 0, float(gain[i, k]) if found else 0.0,
                        whole[i, 0].tobytes(), left[i, j, cut].tobytes()))
        return out

    def grow(self, level: int, found: pa.Table) -> None:
        tree, node, feature, cut, gain = (found.column(c).to_numpy() for c in NAMES[:5])
        counts, left = (np.frombuffer(b"".join(found.column(c).to_pylist())).reshape(len(tree), -1) for c in NAMES[5:])
        if not level:
            self.counts[tree, 1] = counts
        s = np.flatnonzero(feature >= 0)
        tree, node = tree[s], node[s]
        self.feature[tree, node], self.cut[tree, node], self.gain[tree, node] = feature[s], cut[s], gain[s]
        self.counts[tree, 2 * node], self.counts[tree, 2 * node + 1] = left[s], counts[s] - left[s]

    def prune(self) -> None:
        """Two leaves of the same class become one."""
        said = (self.counts * self.weights).argmax(axis=2)
        for level in reversed(range(self.depth)):
            k = np.arange(1 << level, 2 << level)
            leaves = (self.feature[:, 2 * k] < 0) & (self.feature[:, 2 * k + 1] < 0) if level + 1 < self.depth else True
            self.feature[:, k] = np.where(leaves & (said[:, 2 * k] == said[:, 2 * k + 1]) & (self.feature[:, k] >= 0), -1, self.feature[:, k])

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(bins), len(self.weights)))
        for t in range(len(self.feature)):
            c = self.counts[t, self.nodes(t, bins, self.depth)[0]] * self.weights
            votes += c / np.maximum(c.sum(axis=1, keepdims=True), 1e-300)
        return votes / np.maximum(votes.sum(axis=1, keepdims=True), 1e-300)

    def importances(self) -> np.ndarray:
        """Gain times weighted rows of a feature's nodes; every tree's sum to 1, then all."""
        total = np.zeros(len(self.widths))
        size = (self.counts * self.weights).sum(axis=2)
        for t in range(len(self.feature)):
            at = np.flatnonzero(self.feature[t] >= 0)
            own = np.bincount(self.feature[t, at], weights=self.gain[t, at] * size[t, at], minlength=len(total))
            total += own / own.sum() if own.sum() > 0 else own
        return total / total.sum() if total.sum() > 0 else total


def _bins(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("bins")).to_pylist()), dtype=np.uint8).reshape(len(batch), features)


def bagged(counted: DataFrame, trees: int, seed: int) -> DataFrame:
    """``counted`` (row_hash, label, n, bins) with bag: how often its rows are in each tree, 32 bits a tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("row_hash", "n"))
            bag = [np.random.Generator(np.random.Philox(key=(seed << 64) | (k % (1 << 64)))).poisson(c, trees).astype("<u4").tobytes() for k, c in zip(keys, n)]
            yield b.append_column("bag", pa.array(bag, pa.binary()))

    return counted.mapInArrow(run, StructType([*counted.schema.fields, *StructType.fromDDL("bag binary").fields]))


def _histograms(bags: DataFrame, shared, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = shared.value
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            bins = _bins(b, len(trees.widths))
            label = b.column(b.schema.get_field_index("label")).to_numpy().astype(np.int64)
            bag = np.frombuffer(b"".join(b.column(b.schema.get_field_index("bag")).to_pylist()), dtype="<u4").reshape(len(b), -1).T.astype(float)
            for t in range(len(trees.feature)):
                h = trees.histogram(t, level, bins, label, bag[t])
                total[t] = total[t] + h if t in total else h
        for t, h in total.items():
            live = np.flatnonzero(h[:, 0].any(axis=(1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(live), pa.int32()), pa.array((1 << level) + live, pa.int32()),
                                              pa.array([h[k].tobytes() for k in live], pa.binary())], ["tree", "node", "histogram"])

    return bags.mapInArrow(run, HISTOGRAM)


def _splits(histograms: DataFrame, shared, level: int, trees: int) -> DataFrame:
    """Best split of each node, where its tree's histograms meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = shared.value
        shape = (trees.drawn, max(trees.widths), len(trees.weights))
        sums: dict[int, dict[int, np.ndarray]] = {}
        for b in batches:
            for t, k, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                own, h = sums.setdefault(t, {}), np.frombuffer(h).reshape(shape)
                own[k] = own[k] + h if k in own else h
        for t, own in sorted(sums.items()):
            nodes = np.array(sorted(own))
            found = trees.splits(t, level, nodes, np.stack([own[k] for k in nodes]))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), KINDS)], NAMES)

    return histograms.repartition(min(trees, histograms.sparkSession.sparkContext.defaultParallelism), "tree").mapInArrow(run, SPLIT)


def grown(counted: DataFrame, widths: list[int], weights: list[float], trees: int, depth: int, seed: int) -> Trees:
    """A forest on ``counted``: (row_hash, label, n, bins), a row for each distinct pair of bins and label."""
    spark = counted.sparkSession
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-counted.count() // ROWS_A_TASK)))
    dealt = counted if counted.rdd.getNumPartitions() > tasks else counted.repartition(tasks)
    bags = materialize(bagged(dealt, trees, seed), "bags")
    out = Trees(trees, depth, widths, weights, seed)
    for level in range(depth):
        shared = spark.sparkContext.broadcast(out)
        found = _splits(_histograms(bags, shared, level), shared, level, trees).toArrow()
        shared.unpersist()
        if not len(found):
            break
        out.grow(level, found)
    out.prune()
    return out


class ForestModel:
    """Encoder, cuts, classes and trees; applied to rows by their distinct inputs."""

    def __init__(self, encoder: PipelineModel, cuts: list[list[float]], labels: list[str], categorical: list[str], numeric: list[str], trees: Trees):
        self.encoder, self.cuts, self.labels, self.trees = encoder, cuts, labels, trees
        self.categorical, self.numeric = list(categorical), list(numeric)

    @property
    def names(self) -> list[str]:
        vocabularies = self.encoder.stages[0].labelsArray if self.categorical else []
        return [f"{c}_{v}" for c, own in zip(self.categorical, vocabularies) for v in own] + self.numeric

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with probability (an array in the order of labels) and predicted."""
        inputs = self.categorical + self.numeric
        each = rows.select(*inputs).distinct()
        binned = with_bins(self.encoder.transform(each), self.cuts, len(self.cuts) - len(self.numeric)).select(*inputs, "bins")
        shared = rows.sparkSession.sparkContext.broadcast(self.trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = shared.value.probabilities(_bins(b, len(shared.value.widths)))
                yield b.append_column("probability", pa.array(list(p), pa.list_(pa.float64())))

        schema = StructType([*binned.schema.fields, StructField("probability", ArrayType(DoubleType()))])
        scored = materialize(binned.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema).drop("bins"), "forest-scores")
        side = scored.select(*(F.col(c).alias(f"_in{k}") for k, c in enumerate(inputs)), "probability")
        same = F.lit(True)
        for k, c in enumerate(inputs):
            same = same & F.col(c).eqNullSafe(F.col(f"_in{k}"))
        first = F.array_position("probability", F.array_max("probability")).cast("int")
        return rows.join(side, same, "left").drop(*(f"_in{k}" for k in range(len(inputs)))).withColumn(
            "predicted", F.element_at(F.array(*map(F.lit, self.labels)), first))

    def save(self, path: str) -> None:
        """Encoder as an MLlib pipeline, layout and trees as tables."""
        spark, t = SparkSession.active(), self.trees
        self.encoder.write().overwrite().save(f"{path}/encoder")
        layout = {"cuts": self.cuts, "labels": self.labels, "categorical": self.categorical, "numeric": self.numeric, "widths": t.widths,
                  "weights": t.weights.tolist(), "depth": t.depth, "seed": t.seed, "trees": len(t.feature)}
        spark.createDataFrame([(json.dumps(layout),)], "layout string").write.mode("overwrite").parquet(f"{path}/layout")
        used = [(int(i), int(k), int(t.feature[i, k]), int(t.cut[i, k]), float(t.gain[i, k]), t.counts[i, k].tolist()) for i, k in np.argwhere(t.counts.any(axis=2))]
        spark.createDataFrame(used, "tree int, node int, feature int, cut int, gain double, counts array<double>").write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark, path: str) -> ForestModel:
        x = json.loads(spark.read.parquet(f"{path}/layout").first()["layout"])
        t = Trees(x["trees"], x["depth"], x["widths"], x["weights"], x["seed"])
        for r in spark.read.parquet(f"{path}/trees").collect():
            at = r["tree"], r["node"]
            t.feature[at], t.cut[at], t.gain[at], t.counts[at] = r["feature"], r["cut"], r["gain"], r["counts"]
        return cls(PipelineModel.load(f"{path}/encoder"), x["cuts"], x["labels"], x["categorical"], x["numeric"], t)


def fit(train: DataFrame, categorical: list[str], numeric: list[str], label: str, trees: int, depth: int, seed: int, balanced: bool = False) -> ForestModel:
    """A forest on the rows of ``train``, with class weights n / (classes * n of the class) if ``balanced``."""
    inputs = list(categorical) + list(numeric)
    counted = materialize(train.groupBy(*inputs, label).agg(F.count(F.lit(1)).alias("n")), "counted-rows")
    sums = {str(r[label]): r["n"] for r in counted.groupBy(label).agg(F.sum("n").alias("n")).collect() if r[label] is not None}
    labels = sorted(sums)
    weights = [sum(sums.values()) / (len(labels) * sums[x]) if balanced else 1.0 for x in labels]
    encoder = Pipeline(stages=encoder_pipeline(categorical, numeric)).fit(counted)
    encoded = sum(len(x) for x in encoder.stages[0].labelsArray) if categorical else 0
    cuts = numeric_cuts(train, encoded, list(numeric))
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(label).cast("string")).cast("int") - 1
    place = F.when(F.col(label).isNull(), F.raise_error(F.lit(f"null in {label}")).cast("int")).otherwise(place)
    binned = with_bins(encoder.transform(counted), cuts, encoded).select("bins", place.alias("label"), "n")
    alike = materialize(binned.groupBy("bins", "label").agg(F.sum("n").alias("n")).withColumn("row_hash", F.xxhash64("bins", "label")), "alike-rows")
    return ForestModel(encoder, cuts, labels, categorical, numeric, grown(alike, [len(x) + 1 for x in cuts], weights, trees, depth, seed))
