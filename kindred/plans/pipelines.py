"""Four presets of the same operators, from records to decided edges."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import assign, blocking, candidates, features, models, retrieval, veto
from ..sources import writers


@dataclass(frozen=True)
class Limits:
    """Numbers of candidates by channel; 0 leaves a channel out."""

    exact_cap: int = 30
    bm25_name: int = 15
    bm25_combined: int = 15
    tfidf_name: int = 15
    tfidf_address: int = 10


#: What bulk inference runs with.
INFERENCE = Limits(15, 5, 3, 0, 0)


def main_candidates(ref: DataFrame, query: DataFrame, limits: Limits = INFERENCE) -> DataFrame:
    """Seven channels, merged; countries block after ranking. Sides as features.prepared() gives them."""
    keys = {"exact_name": "name_normalized", "exact_address": "address_normalized", "exact_combined": "combined_normalized"}
    channels = {k: blocking.exact(blocking.keyed(ref, F.col(c), "s1_id", 2), blocking.keyed(query, F.col(c), "query_id", 2), limits.exact_cap) for k, c in keys.items()}
    ranked = (("bm25_name", limits.bm25_name, retrieval.bm25_top, "name_transliterated"), ("bm25_combined", limits.bm25_combined, retrieval.bm25_top, "combined_transliterated"), ("tfidf_name", limits.tfidf_name, retrieval.tfidf_top, "name_transliterated"), ("tfidf_address", limits.tfidf_address, retrieval.tfidf_top, "address_transliterated"))
    channels |= {k: top(ref, query, c, n) for k, n, top, c in ranked if n > 0}
    return blocking.country_block(candidates.merged(channels), query, ref)


def main(ref: DataFrame, query: DataFrame, score, absolute: float = 0.65, margin: float = 0.05, limits: Limits = INFERENCE) -> tuple[DataFrame, DataFrame]:
    """(edges, candidates); score: 61 feature columns to a score column, or a fitted model."""
    r, q = writers.kept(features.prepared(ref), "references"), writers.kept(features.prepared(query), "queries")  # read by each channel and by the features
    found = writers.kept(main_candidates(r, q, limits), "candidates")  # read by the features and by the last semi join
    rows = features.main(found, q, r)
    scored = models.predict(score, rows) if not isinstance(score, Column) else rows.withColumn("score", score)
    edges = assign.main(scored.select("query_id", "s1_id", "score"), absolute, margin)
    return edges.join(found.select("query_id", "s1_id"), ["query_id", "s1_id"], "left_semi"), found


def _cleaned(df: DataFrame, unmapped: str) -> DataFrame:
    """n, a (clean name and address) and first, the order within buckets."""
    return text.with_clean(df, {"n": "business_name", "a": "business_address"}, unmapped).withColumn("first", F.col("entity_id"))


def sieve(ref: DataFrame, query: DataFrame, score, absolute: float = 0.5, margin: float = 0.05, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Unique combined keys are locked; the others are scored and vetoed. (edges, candidates)."""
    forms = lambda df: _cleaned(df, "keep").withColumn("c", text.join_fields(F.col("n"), F.col("a")))
    r, q = forms(ref), forms(query)
    locked, _ = blocking.unique_key(blocking.keyed(r, F.col("c"), "s1_id"), blocking.keyed(q, F.col("c"), "query_id"))
    rest = q.join(locked.select(F.col("query_id").alias("entity_id")), "entity_id", "left_anti")
    channels = [(blocking.truncated(blocking.keyed(r, F.col(c), "s1_id", 1, "first"), blocking.keyed(rest, F.col(c), "query_id")), s) for c, s in (("n", 10.0), ("a", 8.0))]
    channels.append((retrieval.bm25_top(r, rest, "c", k, retrieval.SIEVE), None))
    found = writers.kept(candidates.priority_fill(channels, k), "candidates")
    rows = features.sieve(found, query, ref)
    scored = models.predict(score, rows) if not isinstance(score, Column) else rows.withColumn("score", score)
    edges = assign.sieve(locked, veto.apply(scored).select("query_id", "s1_id", "score"), absolute, margin)
    every = found.select("query_id", "s1_id").unionByName(locked.select("query_id", "s1_id")).distinct()
    return edges, every


def hybrid(ref: DataFrame, query: DataFrame, blocked: DataFrame, score, absolute: float = 0.5, margin: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """blocked: merged hybrid candidates. (edges, candidates)."""
    rows = features.hybrid(blocked, features.prepared(query), features.prepared(ref))
    scored = models.predict(score, rows) if not isinstance(score, Column) else rows.withColumn("score", score)
    return assign.hybrid(scored.select("query_id", "s1_id", "score"), absolute, margin), blocked.select("query_id", "s1_id")


def _word_vector(word: str, dims: int) -> np.ndarray:
    """Signed hashes of the trigrams of <word>, the first 32, scaled to length 1."""
    x = f"<{word}>"
    ids = {(int(hashlib.md5(x[i : i + 3].encode()).hexdigest()[:8], 16) & 0x7FFFFFFF) % 65535 + 1 for i in range(min(32, len(x) - 2))}
    v = np.zeros(dims)
    for g in ids:
        v[g % dims] += 1.0 if (g // dims) % 2 == 0 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def token_vectors(records: DataFrame, dims: int = 64) -> DataFrame:
    """(entity_id, v): a unit vector for each word of the serialised record.

    Stands in for a trained token encoder, whose output has the same shape.
    """

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def encode(lines: pd.Series) -> pd.Series:
        known: dict[str, list[float]] = {}

        def of(line: str) -> list[list[float]]:
            for w in line.split():
                if w not in known:
                    known[w] = _word_vector(w, dims).tolist()
            return [known[w] for w in line.split()]

        return lines.map(of)

    line = text.serialize(F.col("n"), F.col("a"), text.country("country"))
    return _cleaned(records, "drop").select("entity_id", encode(line).alias("v"))


@F.pandas_udf(T.DoubleType())
def maxsim(q: pd.Series, d: pd.Series) -> pd.Series:
    """As vectors.maxsim, for many token vectors a record: a matrix product a pair."""
    return pd.Series([float((np.stack(a) @ np.stack(b).T).max(axis=1).mean()) if len(a) and len(b) else 0.0 for a, b in zip(q, d)])


def late(ref: DataFrame, query: DataFrame, absolute: float = 0.6, margin: float = 0.02, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Priority-filled candidates scored by late interaction of token vectors. (edges, candidates)."""
    forms = lambda df: _cleaned(df, "drop").withColumn("c", F.concat_ws(" ", "n", "a"))
    r, q = forms(ref), forms(query)
    channels = [(blocking.truncated(blocking.keyed(r, F.col(c), "s1_id", 1, "first"), blocking.keyed(q, F.col(c), "query_id")), s) for c, s in (("c", 10.0), ("n", 9.0), ("a", 8.0))]
    channels.append((retrieval.bm25_top(r, q, "c", k, retrieval.LATE), None))
    found = writers.kept(candidates.priority_fill(channels, k), "candidates")
    qv, rv = (token_vectors(x).select(F.col("entity_id").alias(i), F.col("v").alias(v)) for x, i, v in ((query, "query_id", "qv"), (ref, "s1_id", "rv")))
    scored = found.select("query_id", "s1_id").join(qv, "query_id").join(rv, "s1_id").select("query_id", "s1_id", F.round(maxsim("qv", "rv"), 6).alias("score"))
    return assign.late(scored, absolute, margin), found.select("query_id", "s1_id")
