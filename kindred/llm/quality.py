"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk, minimised over a small network.

Trusted positives: texts labelled 1. Unlabelled: web text as it comes. Class prior: estimated from these two alone (class_prior),
anew for each corpus; labels of 0 are not used. Features are style measures of a whole text (symbols, capitals, repeats,
lengths); a network of HIDDEN units is fitted in numpy by Adam, in full batches; where the negative part of the risk falls
under zero it is ascended, as the method has it.

Training takes at most TRAIN positives and about TRAIN unlabelled rows, those of the least hash of their id, the prior at most
PRIOR_ROWS of each of these; the rows held out (crc32 of the id, modulo 3, is 1) are in neither.

score: the network's probability, in 0..1, for empty and null texts too; predicted: 1 if score >= 0.5. Without positives every
score is 0, or 0.5 without labels; with fewer than two rows of a kind the prior is the share of 1 among the labels. Null ids: not held out, never trained on. Repeated rows: a result row each.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .langid import held_out

TRAIN, HIDDEN, STEPS, RATE, DECAY, SEED = 20_000, 16, 600, 0.02, 1e-4, 5
PRIOR_ROWS, FOLDS, ROUNDS, PRIOR_STEPS, LEAST_KEPT, DOUBT = 4_000, 5, 4, 300, 0.95, 0.1
_CLASS = np.zeros((256, 6))
_CLASS[65:91, 0] = 1  # capitals
_CLASS[97:123, 1] = 1  # small letters
_CLASS[128:, 1] = 1
_CLASS[48:58, 2] = 1  # digits
for _c in b".,;:'\"-()":
    _CLASS[_c, 3] = 1  # punctuation of writing
for _c in b"\t\n\x0b\x0c\r ":
    _CLASS[_c, 4] = 1
_CLASS[_CLASS.sum(axis=1) == 0, 5] = 1  # symbols
N_FEATURES = 18


def features(text: str | None) -> list[float]:
    b = (text or "").encode()
    w = b.split()
    n, size = len(w), max(1, len(b))
    if not n:
        return [0.0] * N_FEATURES
    shares = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256) @ _CLASS / size
    count = Counter(w)
    lines = [x for x in b.split(b"\n") if x.strip()]
    again = sum(map(eq, w, w[1:])) / n
    triples = n - 2 - len(set(zip(w, w[1:], w[2:]))) if n > 2 else 0
    little = [0.003, 0.0, 0.003, 0.003, 0.0, 0.003]
    return [
        np.log1p(n), size / n / 8, *(float(np.log(x + e) / 3) if e else float(x) for x, e in zip(shares, little)),
        np.log(again + 0.003) / 3, np.log(max(0, triples) / n + 0.003) / 3, len(count) / n, np.log(max(count.values()) / n),
        np.log(len(lines) / n + 0.003) / 3, np.log(1 - len(set(lines)) / len(lines) + 0.01) / 3,
        np.log(len(set(b)) / 64), np.log(sum(v for k, v in count.items() if len(k) == 1) / n + 0.003) / 3,
        np.log(sum(v for k, v in count.items() if len(k) > 20) / n + 0.003) / 3, np.log(b.count(b".") / n + 0.003) / 3,
    ]


def _featurise(batches):
    for b in batches:
        rows = [features(x) for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(rows, pa.list_(pa.float64()))], names=["kind", "x"])


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights of the network that minimises prior * R+(pos) + max(0, R-(unl) - prior * R-(pos)), logistic loss."""
    rng = np.random.default_rng(SEED)
    mean, std = unl.mean(axis=0), unl.std(axis=0) + 1e-3
    x = np.concatenate([pos, unl])
    x, n = (x - mean) / std, len(pos)
    w = {"a": rng.normal(0, 0.3, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        h = np.tanh(x @ w["a"] + w["b"])
        z = h @ w["c"] + w["d"]
        p, soft = sigmoid(z), np.logaddexp(0, z)
        negative = soft[n:].mean() - prior * soft[:n].mean()
        g = np.empty(len(x))
        if negative >= 0:
            g[:n] = prior * (p[:n] - 1) / n - prior * p[:n] / n
            g[n:] = p[n:] / (len(x) - n)
        else:
            g[:n] = prior * p[:n] / n
            g[n:] = -p[n:] / (len(x) - n)
        back = np.outer(g, w["c"]) * (1 - h * h)
        grad = {"a": x.T @ back, "b": back.sum(axis=0), "c": h.T @ g, "d": np.array([g.sum()])}
        for k in w:
            grad[k] = grad[k] + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return w | {"mean": mean, "std": std}


def best_bin(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among unlabelled scores: that of unlabelled over that of positive scores past one threshold.

    Past any threshold the ratio is the prior or more, as negatives may be there too; the threshold is the one of the least
    upper confidence bound, among those that keep LEAST_KEPT of the positives (a minimum over small bins would come out low).
    """
    at = np.unique(pos)
    p, u = (1 - np.searchsorted(np.sort(x), at) / len(x) for x in (pos, unl))
    slack = np.sqrt(np.log(4 / DOUBT) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    best = np.argmin(np.where(p >= LEAST_KEPT, (u + slack) / np.maximum(p, LEAST_KEPT), np.inf))
    return float(u[best] / p[best])


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float | None:
    """Share of positives in unl, with pos a sample of positives; None if either has fewer than two rows.

    Each round fits the network of the round before's prior (0.5 at first) on all folds but one, scores that one, and
    estimates the prior anew from the pooled scores.
    """
    pos, unl = (x[:: max(1, -(-len(x) // PRIOR_ROWS))] for x in (pos, unl))
    folds = min(FOLDS, len(pos), len(unl))
    if folds < 2:
        return None
    mine, other = np.arange(len(pos)) % folds, np.arange(len(unl)) % folds
    prior, p, u = 0.5, np.empty(len(pos)), np.empty(len(unl))
    for _ in range(ROUNDS):
        for k in range(folds):
            w = fit(pos[mine != k], unl[other != k], prior, PRIOR_STEPS)
            p[mine == k], u[other == k] = scores(pos[mine == k], w), scores(unl[other == k], w)
        prior = min(0.99, max(0.01, best_bin(p, u)))
    return prior


def scores(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    if "prior" in w:
        return np.full(len(x), float(w["prior"][0]))
    z = np.tanh((x - w["mean"]) / w["std"] @ w["a"] + w["b"]) @ w["c"] + w["d"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where: Column | None = None) -> dict[str, np.ndarray]:
    """where: of id_col, which rows may be learned from."""
    common.small_batches(docs.sparkSession)
    mine = where if where is not None else F.lit(True)
    own = labels.where(mine & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    share = own.agg(F.avg(F.col("y").cast("double")).alias("p")).first().p
    if share is None or share <= 0:
        return {"prior": np.array([0.5 if share is None else share])}
    mixed = F.xxhash64(F.col("id"))
    ids = F.broadcast(own.where("y = 1").select("id").distinct().orderBy(mixed, "id").limit(TRAIN))
    texts = docs.where(mine & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = max(1, docs.count())
    some = texts.where(F.pmod(mixed, F.lit(1 << 24)) < int(min(1.0, TRAIN / n) * (1 << 24)))
    both = texts.join(ids, "id", "left_semi").select(F.lit(1).alias("kind"), "text").unionByName(some.select(F.lit(0).alias("kind"), "text"))
    got = both.mapInArrow(_featurise, "kind int, x array<double>").toArrow()
    kind, x = got.column("kind").to_numpy(), np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, N_FEATURES)
    order = np.lexsort(x.T)  # rows come in any order; sums of floats should not
    kind, x = kind[order], x[order]
    pos, unl = x[kind == 1], x[kind == 0]
    if not len(pos) or not len(unl):
        return {"prior": np.array([share])}
    return fit(pos, unl, class_prior(pos, unl) or min(share, 0.99))


def _apply(model):
    def run(batches):
        w = model.value
        for b in batches:
            x = np.array([features(t) for t in b.column("__text").to_pylist()], dtype=np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("held_out"), pa.array(scores(x, w))], names=["__id", "held_out", "score"])

    return run


def predict(docs: DataFrame, model: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", mod: int = 3, rest: int = 1) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    src = docs.select(F.col(id_col).alias("__id"), held_out(id_col, mod, rest).alias("held_out"), F.col(text_col).alias("__text"))
    schema = f"__id {dict(src.dtypes)['__id']}, held_out boolean, score double"
    got = src.mapInArrow(_apply(spark.sparkContext.broadcast(model)), schema)
    return got.withColumnRenamed("__id", id_col).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted over whole documents; learned from rows whose crc32 mod 3 is not 1."""
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs, common.table(spark, sf_dir, "labels"), where=~held_out("doc_id", 3, 1)))


def _keep(model):
    def run(batches):
        w = model.value
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()], dtype=np.float64).reshape(-1, N_FEATURES)
            yield b.filter(pa.array(scores(x, w) >= 0.5))

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score under 0.5 go, all others stay as they are."""
    model = train(docs, common.table(spark, sf_dir, "labels"), where=~held_out("doc_id", 3, 1))
    common.small_batches(spark)
    return docs.mapInArrow(_keep(spark.sparkContext.broadcast(model)), docs.schema)
