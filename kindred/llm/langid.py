"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased; every run of characters other than letters is one space. N-grams of 1 to MAX_N code points are hashed
into BUCKETS; the matrix of log-probabilities (buckets x languages, floats: at most 64 MB, as with over 256 languages each halving of the buckets makes room for twice as many) is
broadcast, and a text's score is the sum of its n-grams' rows: a batch of texts is a sparse matrix, whose rows are summed in numpy over the whole
texts, in pieces so that memory is bounded.

Training takes at most TRAIN_DOCS texts of a language, those of the least hash of their id; every value of lang is learned. Laplace smoothing ALPHA, class priors from all training rows.

lang_pred is `und` with score 0 where the text is null or has no letter, or where nothing could be learned; else score is the
predicted language's posterior, tempered by the square root of the count of n-grams, as these are not independent.
Null ids: held_out null is taken as false. Repeated rows: a result row each. Ties: the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_N, BUCKETS, TRAIN_DOCS, CELLS, ALPHA, PIECE = 3, 1 << 16, 3000, 1 << 24, 0.05, 1 << 20
#: Languages whose shares are broadcast (a name and a number each); more are joined as the planner sees fit.
BROADCAST_LANGS = 100_000


def _codes(text: str) -> np.ndarray:
    """Code points, lower-cased, each run of non-letters as one 32, with one at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    if len(c) and c.max() < 128:
        letter = (c >= 97) & (c <= 122)
    else:
        u, inv = np.unique(c, return_inverse=True)
        letter = np.array([chr(x).isalpha() for x in u.tolist()], dtype=bool)[inv] if len(u) else np.zeros(0, dtype=bool)
    c = np.where(letter, c, np.uint32(32))
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    c = c[keep]
    return np.concatenate([[np.uint32(32)], c[c[:1].tolist() == [32] :] if len(c) else c, [np.uint32(32)]])


def grams(text: str) -> list[np.ndarray]:
    """Buckets of the text's n-grams, in pieces."""
    if not any(map(str.isalpha, text)):
        return []
    c = _codes(text).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for s in range(0, len(c), PIECE):
            x = c[s : s + PIECE + MAX_N - 1]
            h = np.zeros(len(x), dtype=np.uint64)
            for n in range(1, MAX_N + 1):
                h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :]
                y = h[:PIECE] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
                out.append(((y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
                if len(h) < 2:
                    break
    return out


def held_out(id_col: str, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            for g in grams(text):
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, dtype=np.int64)
                total[lang] += np.bincount(g, minlength=BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-probabilities: a power of two of rows, and one of priors)."""
    common.small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (where if where is not None else F.lit(True))).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0), dtype=np.float32)
    share = docs.sparkSession.createDataFrame([(k, min(1.0, TRAIN_DOCS / n)) for k, n in sizes.items()], "lang string, share double")
    if len(sizes) <= BROADCAST_LANGS:
        share = F.broadcast(share)  # texts are not shuffled by language, of which one may hold most rows
    part = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(share, "lang").where(part < F.col("share")).select("lang", "text")
    got = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    buckets = min(BUCKETS, 1 << max(0, int(np.log2(CELLS / len(langs)))))
    m = np.full((buckets + 1, len(langs)), ALPHA)
    np.add.at(m, (got.column("bucket").to_numpy() % buckets, np.array([at[x] for x in got.column("lang").to_pylist()], dtype=np.int64)), got.column("n").to_numpy())
    m[:-1] = np.log(m[:-1] / m[:-1].sum(axis=0))
    m[-1] = np.log([sizes[x] / sum(sizes.values()) for x in langs])
    return langs, m.astype(np.float32)


def classify(texts: list[str | None], langs: list[str], m: np.ndarray) -> list[tuple[str, float]]:
    """(language, score) of each text of a batch."""
    counts = np.zeros(len(texts), dtype=np.int64)
    total = np.repeat(m[-1:].astype(np.float64), len(texts), axis=0)
    held: list[tuple[int, np.ndarray]] = []
    room = 0

    def flush() -> None:
        if held:
            size = np.array([len(x) for _, x in held])
            rows = m[np.concatenate([x for _, x in held]) & (len(m) - 2)]
            np.add.at(total, np.array([i for i, _ in held]), np.add.reduceat(rows, np.cumsum(size) - size, axis=0, dtype=np.float64))
            held.clear()

    for i, text in enumerate(texts):
        for g in grams(text) if text and langs else []:
            counts[i] += len(g)
            for s in range(0, len(g), 1 << 16):
                held.append((i, g[s : s + (1 << 16)]))
                room += len(held[-1][1])
                if room * len(langs) > 1 << 20:
                    flush()
                    room = 0
    flush()
    out = [("und", 0.0)] * len(texts)
    for i in np.flatnonzero(counts):
        best = int(total[i].argmax())
        out[i] = langs[best], float(1 / np.exp((total[i] - total[i][best]) / np.sqrt(counts[i])).sum())
    return out


def _apply(model):
    def run(batches):
        langs, m = model.value
        for b in batches:
            got = classify(b.column("__text").to_pylist(), langs, m)
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["__id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", mod: int = 4, rest: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    src = docs.select(F.col(id_col).alias("__id"), held_out(id_col, mod, rest).alias("held_out"), F.col(text_col).alias("__text"))
    schema = f"__id {dict(src.dtypes)['__id']}, held_out boolean, lang_pred string, score double"
    return src.mapInArrow(_apply(spark.sparkContext.broadcast(model)), schema).withColumnRenamed("__id", id_col)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score over whole documents; learned from rows whose crc32 mod 4 is not 2."""
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs, where=~held_out("doc_id", 4, 2)))
