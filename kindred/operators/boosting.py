"""Boosted trees as the main variant fits them: grown by the best leaf, Newton steps, early stopping with patience.

Spark's trees grow by level and stop at the first rise of the loss, and each level of each tree is a job. Here features
are put in at most 255 bins, a byte each, by quantiles over all rows, and a model is fitted within one task, many models
at a time. All rows are fitted to. What one task holds is bounded by its caller (`models.TASK_BYTES`).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the main variant, then those of its library that it leaves alone.
TREES, RATE, LEAVES, SHARE, PATIENCE, SEED = 500, 0.05, 45, 0.8, 40, 42
BINS, LEAF_ROWS, LEAF_HESSIAN = 255, 20, 1e-3
#: Cells of a small node, counted in one call.
SMALL = 1 << 16


def packed(train: DataFrame, val: DataFrame, columns: list[str], label: str = "is_match") -> DataFrame:
    """Rows in batches: __held, __y and each column as bytes (labels, bins), query_id and s1_id as lists, of held-out rows only."""
    ids = {i: train.schema[i].dataType.simpleString() for i in ("query_id", "s1_id")}
    real = [F.col(c).cast("double").alias(c) for c in columns]
    edges = [np.unique(e) for e in train.select(*real).approxQuantile(columns, [i / BINS for i in range(1, BINS)], 1 / (4 * BINS))]
    rows = [df.select("query_id", "s1_id", F.lit(held).alias("__held"), F.col(label).cast("int").alias("__y"), *real) for df, held in ((train, False), (val, True))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b["__held"].to_numpy(zero_copy_only=False)
            x = [np.searchsorted(e, b[c].to_numpy(zero_copy_only=False)).astype(np.uint8) for c, e in zip(columns, edges)]
            y = (b["__y"].to_numpy(zero_copy_only=False) == 1).astype(np.uint8)
            for part in (False, True):
                if (of := held == part).any():
                    names = [b[i].filter(pa.array(of & held)) for i in ids]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in names]
                    yield pa.RecordBatch.from_arrays([pa.array([part]), *lists, *(pa.array([v[of].tobytes()]) for v in (y, *x))], names=["__held", *ids, "__y", *columns])

    out = "__held boolean, " + ", ".join(f"{i} array<{t}>" for i, t in ids.items()) + ", __y binary, " + ", ".join(f"`{c}` binary" for c in columns)
    return rows[0].unionByName(rows[1]).mapInArrow(pack, out)


def scores(rows: DataFrame, columns: list[str], trees: int = TREES, rate: float = RATE, patience: int = PATIENCE) -> DataFrame:
    """(query_id, s1_id, score) of the held-out rows of a packed table, by a model fitted to the others within one task."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids = {False: [], True: []}, []
        for b in batches:
            for held, *v in zip(b["__held"].to_pylist(), *(b[c] for c in ("__y", *columns))):
                parts[held].append([np.frombuffer(a.as_buffer(), np.uint8) for a in v])
            ids.append([b[i].flatten() for i in ("query_id", "s1_id")])
        (y, x), (yv, xv) = ((a[0], a[1:]) for a in (np.array([np.concatenate(v) for v in zip(*p)]) if p else np.empty((len(columns) + 1, 0), np.uint8) for p in (parts[False], parts[True])))
        if len(yv):
            names = [pa.concat_arrays([v[i] for v in ids]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(1 / (1 + np.exp(-boost(x, y, xv, yv, trees, rate, patience)[0])))], names=["query_id", "s1_id", "score"])

    out = "".join(f"{i} {rows.schema[i].dataType.elementType.simpleString()}, " for i in ("query_id", "s1_id"))
    return rows.select("__held", "query_id", "s1_id", "__y", *columns).coalesce(1).mapInArrow(fit, out + "score double")


def _merged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different columns of x (bins of a row), how many rows have them, how many of label 1, and the place of each row among them."""
    of, size = np.zeros(len(y), np.int64), 1
    for f in x if len(y) else ():
        if size > 1 << 54:
            of = np.unique(of, return_inverse=True)[1]
            size = len(y)
        width = int(f.max()) + 1
        of, size = of * width + f, size * width
    first, of = np.unique(of, return_index=True, return_inverse=True)[1:]
    return x[:, first], np.bincount(of, minlength=len(first)).astype(float), np.bincount(of, y, len(first)), of


def boost(x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, trees: int = TREES, rate: float = RATE, patience: int = PATIENCE) -> tuple[np.ndarray, int, int]:
    """Log odds of the held-out rows after the trees of least loss there, how many these are, and how many were fitted.

    x, xv: bins, a row each feature; y, yv: 0 or 1. Fitting ends once patience trees have not lowered the loss. Rows of the
    same bins have the same odds, whatever the trees, so each such row is there once, with its counts, which is exact.
    """
    x, xv = (v[[len(f) > 0 and f.min() < f.max() for f in x]] for v in (x, xv))
    (x, n, s, _), (xv, nv, sv, of) = _merged(x, y), _merged(xv, yv)
    p = min(max(s.sum() / n.sum() if len(n) else 0.0, 1e-15), 1 - 1e-15)
    f, fv = (np.full(len(v), np.log(p / (1 - p))) for v in (n, nv))
    best, least, kept, m, rng = fv.copy(), np.inf, 0, 0, np.random.RandomState(SEED)
    while m < trees and m - kept < patience and len(x):
        m += 1
        p = 1 / (1 + np.exp(-f))
        some = np.sort(rng.permutation(len(x))[: max(1, round(SHARE * len(x)))])
        for value, rows, held in _tree(x, xv, some, n, n * p - s, n * p * (1 - p)):
            f[rows] += rate * value
            fv[held] += rate * value
        loss = np.sum(nv * np.logaddexp(0, fv) - sv * fv)
        if loss < least:
            best, least, kept = fv.copy(), loss, m
    return best[of], kept, m


def _tree(x: np.ndarray, xv: np.ndarray, some: np.ndarray, n: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(value, rows, held-out rows) of each leaf of a tree on the gradients g and h of rows that stand for n; of two children only the smaller is counted."""
    width = int(x.max()) + 1
    start = np.arange(len(some))[:, None] * width

    def count(rows: np.ndarray) -> np.ndarray:
        gr, hr = (g, h) if len(rows) == len(g) else (g[rows], h[rows])
        if len(rows) * len(some) <= SMALL:
            code = (x[some[:, None], rows] + start).ravel()
            return np.array([np.bincount(code, np.tile(w, len(some)), len(some) * width) for w in (gr, hr)]).reshape(2, len(some), width)
        out = np.empty((2, len(some), width))
        for i, c in enumerate(some):
            code = (x[c] if gr is g else x[c][rows]).astype(np.intp)
            out[0, i], out[1, i] = np.bincount(code, gr, width), np.bincount(code, hr, width)
        return out

    def node(rows: np.ndarray, held: np.ndarray, of: np.ndarray) -> tuple:
        """(-gain, number, feature, last bin to the left, rows, held-out rows, histogram, gradients)."""
        nonlocal made
        made += 1
        total = of[:, 0].sum(1)
        size = n[rows].sum()
        if size < 2 * LEAF_ROWS or total[1] < 2 * LEAF_HESSIAN:
            return 0.0, made, 0, 0, rows, held, of, total
        left = of.cumsum(2)
        right = total[:, None, None] - left
        least = max(LEAF_HESSIAN, (LEAF_ROWS - 0.5) * total[1] / size)  # rows of a side are judged by their hessians, as there
        ok = (left[1] >= least) & (right[1] >= least)
        gain = np.where(ok, left[0] ** 2 / np.where(ok, left[1], 1) + right[0] ** 2 / np.where(ok, right[1], 1) - total[0] ** 2 / total[1], 0)
        c, b = np.unravel_index(gain.argmax(), gain.shape)
        return -gain[c, b], made, some[c], b, rows, held, of, total

    made, whole = 0, np.arange(len(g))
    heap, done = [node(whole, np.arange(xv.shape[1]), count(whole))], []
    while heap:
        gain, _, c, b, rows, held, of, total = heapq.heappop(heap)
        if gain > -1e-12 or len(heap) + len(done) + 1 >= LEAVES:
            done.append((-total[0] / total[1] if total[1] > 0 else 0.0, rows, held))
            continue
        low, low_held = x[c][rows] <= b, xv[c][held] <= b
        sides = [(rows[low], held[low_held]), (rows[~low], held[~low_held])]
        small = int(len(sides[1][0]) < len(sides[0][0]))
        less = count(sides[small][0])
        for i, (r, v) in enumerate(sides):
            heapq.heappush(heap, node(r, v, less if i == small else of - less))
    return done
