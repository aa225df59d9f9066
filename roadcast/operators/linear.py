"""Linear members of votes and stacks for many folds at once, from sums of products (EX8, EX9, EX12).

A library fit scans the training rows up to a hundred times for each fold. Sums of products of the inputs (one matrix a
fold) are all that a ridge regression needs: one pass serves every fold, as those of a held-out fold are taken off the
whole's. A logistic regression takes Newton steps, a handful of passes that serve all folds; a step that raises the loss is
halved. Both have MLlib's objectives: inputs divided by their deviations, a penalty on all coefficients but the intercept,
inputs that don't vary left out; a label of one class gives that class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, TOLERANCE = 100, 1e-9
PORTION = 4096


def _inputs(column: pa.Array, inputs: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), inputs)


def _sums(rows: DataFrame, inputs: int, parts: list, of_part) -> list[np.ndarray]:
    """For each of ``parts`` the sum over all rows of ``of_part(part, x with a last column of ones, y, fold)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for lo in range(0, len(b), PORTION):
                some = b.slice(lo, PORTION)
                x = np.column_stack([_inputs(some.column(2), inputs), np.ones(len(some))])
                y, fold = some.column(0).to_numpy(), some.column(1).to_numpy()
                for k, part in enumerate(parts):
                    one = of_part(part, x, y, fold)
                    if one is not None:
                        total[k] = total[k] + one if k in total else one
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "sums"])

    each = rows.select("y", "fold", vector_to_array("features").alias("x")).mapInArrow(run, "part int, sums binary")
    out = [None] * len(parts)
    for r in sorted(each.collect(), key=lambda r: (r["part"], bytes(r["sums"]))):  # in an order that doesn't depend on the tasks'
        one = np.frombuffer(r["sums"])
        out[r["part"]] = one if out[r["part"]] is None else out[r["part"]] + one
    return out


def _products(fold: int, x: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray | None:
    own = of == fold
    if not own.any():
        return None
    both = np.column_stack([x[own], y[own]])
    return (both.T @ both).reshape(-1)


def products(rows: DataFrame, inputs: int, folds: list[int]) -> dict[int | None, np.ndarray]:
    """Sums of products of (inputs, 1, y): of all trained rows (None) and of those outside each fold."""
    own = _sums(rows, inputs, folds, _products)
    own = [np.zeros((inputs + 2) ** 2) if s is None else s for s in own]
    whole = sum(own)
    return {h: s.reshape(inputs + 2, -1) for h, s in [(None, whole), *((f, whole - s) for f, s in zip(folds, own))]}


def _moments(s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, deviations of the population) of inputs and y."""
    n = s[-2, -2]
    place = np.r_[0:len(s) - 2, len(s) - 1]
    mean = s[place, -2] / n
    return n, mean, np.sqrt(np.maximum(s[place, place] / n - mean**2, 0.0))


def ridge(s: np.ndarray, penalty: float) -> np.ndarray:
    """(coefficients, intercept) of a linear regression on sums of products; the penalty as MLlib's regParam."""
    n, mean, deviation = _moments(s)
    inputs = len(s) - 2
    out = np.zeros(inputs + 1)
    live = np.flatnonzero(deviation[:-1] > 1e-9 * np.maximum(1.0, np.abs(mean[:-1])))
    if deviation[-1] > 0 and len(live):
        scale = deviation[live]
        a = (s[np.ix_(live, live)] / n - np.outer(mean[live], mean[live])) / np.outer(scale, scale)
        b = (s[live, -1] / n - mean[live] * mean[-1]) / scale / deviation[-1]
        out[live] = np.linalg.solve(a + penalty / deviation[-1] * np.eye(len(live)), b) * deviation[-1] / scale
    out[-1] = mean[-1] - out[:-1] @ mean[:-1]
    return out


def _step(part: tuple, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray | None:
    """Loss, gradient and second derivatives of the logistic loss on the rows outside a fold."""
    held_out, beta = part
    own = fold >= 0 if held_out is None else (fold >= 0) & (fold != held_out)
    if not own.any():
        return None
    x, y = x[own], y[own]
    z = x @ beta
    p = 1.0 / (1.0 + np.exp(-z))
    return np.r_[np.logaddexp(0.0, z).sum() - y @ z, x.T @ (p - y), (x.T @ (x * (p * (1.0 - p))[:, None])).reshape(-1)]


def logistic(rows: DataFrame, inputs: int, sums: dict[int | None, np.ndarray], held_out: list[int | None], penalty: float) -> dict[int | None, np.ndarray]:
    """(coefficients, intercept) for each fold that is held out; ``sums`` are those of :func:`products`."""
    scale, live, beta, before, done = {}, {}, {}, {}, set()
    for h in held_out:
        n, mean, deviation = _moments(sums[h])
        live[h] = np.r_[np.flatnonzero(deviation[:-1] > 1e-9 * np.maximum(1.0, np.abs(mean[:-1]))), inputs]
        scale[h] = np.r_[deviation[live[h][:-1]] * np.sqrt(n / max(n - 1, 1.0)), 1.0]
        beta[h], share = np.zeros(inputs + 1), mean[-1]
        if share <= 0 or share >= 1:
            beta[h][-1] = np.inf if share >= 1 else -np.inf
            done.add(h)
        else:
            beta[h][-1] = np.log(share / (1 - share))
    for _ in range(STEPS):
        asked = [h for h in held_out if h not in done]
        if not asked:
            break
        for h, found in zip(asked, _sums(rows, inputs, [(h, beta[h]) for h in asked], _step)):
            n, at, size = sums[h][-2, -2], live[h], inputs + 1
            weight = beta[h][at] * scale[h]  # of inputs divided by their deviations
            held = np.r_[np.full(len(at) - 1, penalty), 0.0]
            loss = found[0] / n + 0.5 * (held * weight**2).sum()
            if h in before and loss > before[h][0] + 1e-12 * abs(before[h][0]) and np.abs(beta[h] - before[h][1]).max() > TOLERANCE:
                beta[h] = (beta[h] + before[h][1]) / 2
                continue
            before[h] = (loss, beta[h].copy())
            gradient = found[1:1 + size][at] / n / scale[h] + held * weight
            second = found[1 + size:].reshape(size, size)[np.ix_(at, at)] / n / np.outer(scale[h], scale[h]) + np.diag(held)
            move = np.linalg.lstsq(second, gradient, rcond=None)[0]
            beta[h] = beta[h].copy()
            beta[h][at] -= move / scale[h]
            if np.abs(move).max() < TOLERANCE:
                done.add(h)
    return beta


def predicted(spark, beta: dict[int | None, np.ndarray]) -> Column:
    """A row's intercept and products, by the coefficients that hold out its fold."""
    shared = spark.sparkContext.broadcast(beta)

    @F.arrow_udf("double")
    def run(x: pa.Array, fold: pa.Array) -> pa.Array:
        of, own = fold.to_numpy(), shared.value
        x = _inputs(x, len(next(iter(own.values()))) - 1)
        out = np.full(len(x), np.nan)
        for h, b in own.items():
            at = of == h if h is not None else ~np.isin(of, [f for f in own if f is not None])
            out[at] = x[at] @ b[:-1] + b[-1]
        return pa.array(out, pa.float64())

    return run(vector_to_array("features"), F.col("fold"))
