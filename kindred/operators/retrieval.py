"""Similarity joins with per-query top k over sparse vectors (id, t, w): numbers of terms and their weights.

Vectors are made by joins and aggregates; scoring is a sparse dot product in numpy over blocks of queries and reference
records, which leaves out records that cannot be among a query's best (see search and Block). Terms in over max_df of the reference records are out, which bounds the longest posting list. Scores are rounded before ranking, ties go by s1_id, so float order cannot flip a rank.
Corpus scalars (number of records, mean length) travel as a one-row broadcast.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables, text
from ..sources import readers, writers

DIGITS, FLOOR = 6, 0.001


@dataclass(frozen=True)
class Bm25:
    """main: stop words, df limit, distinct query terms. sieve and late: none of the first two, query terms count by frequency."""

    k1: float = 1.5
    b: float = 0.75
    stop_words: tuple[str, ...] = tuple(tables.STOP_WORDS)
    max_df: float = 0.25
    max_features: int = 100_000
    query_tf: bool = False
    floor_idf: bool = False
    small: int = 0  # below so many records max_df is 1


MAIN = Bm25()
SIEVE = Bm25(stop_words=(), query_tf=True, floor_idf=True, max_features=80_000, small=20)
LATE = Bm25(stop_words=(), query_tf=True, floor_idf=True)


def tokens(records: DataFrame, column: str, id_as: str) -> DataFrame:
    """(id, term, tf)."""
    return records.select(F.col("entity_id").alias(id_as), F.explode(text.terms(F.lower(F.col(column)))).alias("term")).groupBy(id_as, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n: DataFrame, mode: Bm25) -> DataFrame:
    """(term, df) of the terms in use: no stop words, not too frequent, the max_features of highest count (ties by term)."""
    base = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def kept(stop_words, max_df: float) -> DataFrame:
        x = base.where(~F.col("term").isin(list(stop_words))) if stop_words else base
        if max_df < 1:
            x = x.join(F.broadcast(n)).where((F.col("df") <= max_df * F.col("n")) | (F.col("n") < mode.small)).drop("n")
        return x.orderBy(F.desc("cf"), "term").limit(mode.max_features).select("term", "df")

    if mode.stop_words and base.where(~F.col("term").isin(list(mode.stop_words))).isEmpty():
        return kept((), 1.0)  # a corpus of stop words only
    return kept(mode.stop_words, mode.max_df)


def numbered(terms: DataFrame) -> DataFrame:
    """terms written once, each with a number t."""
    return writers.kept(terms.withColumn("t", F.monotonically_increasing_id()), "terms")


def vectors(rows: DataFrame, by: str, weight: str = "w") -> DataFrame:
    """(by, t, w): a row for each id, of rows (by, t, weight)."""
    return rows.groupBy(by).agg(F.collect_list(F.struct("t", F.col(weight).cast("double").alias("w"))).alias("v")).select(by, "v.t", "v.w")


def bm25_top(reference: DataFrame, query: DataFrame, column: str, k: int, mode: Bm25 = MAIN) -> DataFrame:
    """(query_id, s1_id, score, rank)."""
    counts = writers.kept(tokens(reference, column, "s1_id"), "counts")  # read by the vocabulary, the lengths and the weights
    n = reference.agg(F.count("*").alias("n"))
    used = numbered(vocabulary(counts, n, mode))
    inside = counts.join(used, "term").drop("term")
    length = inside.groupBy("s1_id").agg(F.sum("tf").alias("len"))
    corpus = inside.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")).join(n)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    idf = F.greatest(idf, F.lit(0.0)) if mode.floor_idf else idf
    norm = mode.k1 * (1 - mode.b + mode.b * F.col("len") / (F.col("total") / F.col("n")))
    weights = inside.join(length, "s1_id").join(F.broadcast(corpus)).select("t", "s1_id", (F.col("tf") * (mode.k1 + 1) / (F.col("tf") + norm) * idf).alias("w"))
    q = tokens(query, column, "query_id").join(used.select("term", "t"), "term").withColumn("q", F.col("tf").cast("double") if mode.query_tf else F.lit(1.0))
    return search(vectors(q, "query_id", "q"), vectors(weights, "s1_id"), k)


#: Terms, not records, so that long texts make smaller blocks (at most about 300 MB a task); postings looked at first for a query.
POSTINGS_BLOCK, QUERY_BLOCK, LEAST_BLOCK, FIRST_LOOK = 5_000_000, 500_000, 5_000, 128
#: Postings looked at before records are scored, as a multiple of those it takes; tasks of a search at most (a task may then meet several pairs of blocks).
MORE, TASKS = 4, 10_000
#: Queries that are looked up together; postings, and terms of the records scored, of one of them at most.
BATCH, BATCH_LOOK = 32, 50_000


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i] .. first[i] + size[i] - 1 of all i, in their order."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """Reference vectors by record and by term. vectors: sizes, then terms and weights end to end; records in the order that decides ties.

    A query's terms are looked up from the rarest on. The records met are scored over all terms; the others share only the terms
    left, so none scores more than these terms' greatest weights allow. The k-th score found says how many terms it takes until that
    is too little, and which records met cannot reach it: nothing that could be among the k best is left out.
    """

    def __init__(self, size: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.size, self.weight = size, weight
        self.first = np.cumsum(size) - size
        coded = pa.array(term).dictionary_encode()
        met = coded.dictionary.to_numpy(zero_copy_only=False)
        order = np.argsort(met)
        self.terms, place = met[order], np.empty(len(met), np.int32)
        place[order] = np.arange(len(met))
        self.number = place[coded.indices.to_numpy(zero_copy_only=False)]
        # by term, then by place: sorting the two as one number takes a fraction of a stable argsort's time
        order = self.number.astype(np.int64) << 32
        order |= np.arange(len(term))
        order.sort()
        order &= 0xFFFFFFFF
        self.record, self.by_term = np.repeat(np.arange(len(size), dtype=np.int32), size)[order], weight[order]
        self.df = np.bincount(self.number, minlength=len(self.terms))
        self.at = np.cumsum(self.df) - self.df
        self.greatest = np.maximum.reduceat(self.by_term, self.at) if len(self.terms) else self.by_term
        self.factor = np.zeros(len(self.terms))
        self.mean = max(1.0, len(term) / max(1, len(size)))
        self.looked = 0

    def _all(self, t: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Records that share a term with the query, and their scores."""
        places = _spans(self.at[t], self.df[t])
        self.looked += len(places)
        met, part = self.record[places], self.by_term[places] * np.repeat(factor, self.df[t])
        if len(met) * 8 < len(self.size):  # few records share a term: the others are not looked at
            some, place = np.unique(met, return_inverse=True)
            return some, np.bincount(place, weights=part)
        score = np.bincount(met, weights=part, minlength=len(self.size))
        some = np.flatnonzero(score > 0)
        return some, score[some]

    def _some(self, t: np.ndarray, factor: np.ndarray, j: int, left: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Records that share one of the first j terms with the query and may reach `least` with the others, which add `left` at most; and their scores."""
        some, part = self._all(t[:j], factor[:j])
        some = some[np.round(part + left + 1e-9, DIGITS) >= least]
        if not len(some):
            return some, np.empty(0)
        places = _spans(self.first[some], self.size[some])
        self.looked += len(places)
        self.factor[t] = factor
        score = np.add.reduceat(self.weight[places] * self.factor[self.number[places]], np.cumsum(self.size[some]) - self.size[some])
        self.factor[t] = 0
        return some, score

    def top(self, term: np.ndarray, factor: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best records of a query over the floor, and their rounded scores."""
        if not len(self.terms):
            return np.empty(0, int), np.empty(0)
        t = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[t] == term
        t, factor = t[known], factor[known]
        order = np.argsort(self.df[t], kind="stable")
        t, factor = t[order], factor[order]
        reached = np.cumsum(self.df[t])
        left = np.append(np.cumsum((factor * np.maximum(self.greatest[t], 0))[::-1])[::-1], 0.0)
        most = np.round(left + 1e-9, DIGITS)  # of a record that shares only the terms from there on
        j, least = max(1, int(np.searchsorted(reached, FIRST_LOOK, "right"))), floor
        while True:
            whole = j >= len(t) or reached[j - 1] * (self.mean if least == floor else 4) >= reached[-1]
            some, score = self._all(t, factor) if whole else self._some(t, factor, j, left[j], least)
            score = np.round(score, DIGITS)
            some, score = some[score > floor], score[score > floor]
            if len(some) > k:
                least = score >= np.partition(score, len(some) - k)[len(some) - k]
                some, score = some[least], score[least]
                best = np.lexsort((some, -score))[:k]
                some, score = some[best], score[best]
            if whole or most[j] <= floor or (len(some) == k and most[j] < score.min()):
                return some, score
            if len(some) == k:  # as many terms as it takes for the others not to reach these
                least = score.min()
                j = int(np.argmax(most < least))
                # and some more, which cost little: the fewer terms are left, the fewer of the records met can reach these
                j = max(j, int(np.searchsorted(reached, min(MORE * reached[j - 1], (reached[-1] - 1) // 4), "right")))
            else:
                j = int(np.searchsorted(reached, max(4 * reached[j - 1], reached[j]), "right"))


def _within(n: np.ndarray) -> np.ndarray:
    """Number of the group of each value, of groups of so many values end to end."""
    return np.repeat(np.arange(len(n)), n)


class Batch:
    """Block.top for several queries at once, whose first two looks go through the same few calls; queries that take more go one by one."""

    def __init__(self, block: Block, k: int, floor: float):
        self.block, self.k, self.floor = block, k, floor
        self.code = np.zeros(len(block.terms), np.int32)

    def _met(self, q: np.ndarray, j: np.ndarray, left: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As Block._some, of each query q with its first j terms: (query, record, score), and the queries that are left out as too many would be scored."""
        b = self.block
        at = _spans(self.first[q], j)
        t = self.t[at]
        places, many = _spans(b.at[t], b.df[t]), b.df[t]
        b.looked += len(places)
        key = np.repeat(np.repeat(q, j), many) << 32
        key |= b.record[places]
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        part = np.add.reduceat((b.by_term[places] * np.repeat(self.factor[at], many))[order], head)
        of, some = key[head] >> 32, key[head] & 0xFFFFFFFF
        may = np.round(part + left[of] + self.slack, DIGITS) >= least[of]
        of, some = of[may], some[may]
        out = np.bincount(of, weights=b.size[some], minlength=len(left)) > BATCH_LOOK
        of, some = of[~out[of]], some[~out[of]]
        if not len(some):
            return of, some, np.empty(0), np.flatnonzero(out)
        size = b.size[some]
        places = _spans(b.first[some], size)
        b.looked += len(places)
        score = b.weight[places] * self.weights[np.repeat(of * self.width, size) + self.code[b.number[places]]]
        return of, some, np.round(np.add.reduceat(score, np.cumsum(size) - size), DIGITS), np.flatnonzero(out)

    def _best(self, of: np.ndarray, some: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each query's k best over the floor, in order, how many these are, and the last one's score."""
        over = score > self.floor
        of, some, score = of[over], some[over], score[over]
        order = np.lexsort((some, -score, of))
        many = np.bincount(of, minlength=n)
        order = order[np.arange(len(order)) - np.repeat(np.cumsum(many) - many, many) < self.k]
        many = np.minimum(many, self.k)
        last = np.full(n, self.floor)
        last[many > 0] = score[order][(np.cumsum(many) - 1)[many > 0]]
        return of[order], some[order], score[order], many, last

    def top(self, size: np.ndarray, term: np.ndarray, factor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Block.top of each query."""
        b, n = self.block, len(size)
        found: list = [None] * n
        if len(b.terms):
            t = np.minimum(np.searchsorted(b.terms, term), len(b.terms) - 1)
            known = b.terms[t] == term
            q, t, f = _within(size)[known], t[known], factor[known]
            order = np.lexsort((b.df[t], q))
            self.t, self.factor, df = t[order], f[order], b.df[t[order]]
            many = np.bincount(q, minlength=n)
            self.first = first = np.cumsum(many) - many
            reached = np.cumsum(df)
            reached -= np.repeat(np.append(0, reached)[first], many)
            worth = np.append(0, np.cumsum(self.factor * np.maximum(b.greatest[self.t], 0)))
            self.slack = 1e-9 + 1e-12 * worth[-1]  # of sums that span all queries
            rest = np.repeat(worth[first + many], many) - worth[:-1]  # of the terms from there on
            most = np.round(rest + self.slack, DIGITS)
            distinct, place = np.unique(self.t, return_inverse=True)
            self.width = len(distinct) + 1
            self.code[distinct] = np.arange(1, self.width)
            self.weights = np.zeros(n * self.width)
            self.weights[q * self.width + place + 1] = self.factor
            ends = lambda q, j: reached[first[q] + j - 1]
            # the first look, of the queries that need not be scored over all terms at once
            j = np.maximum(1, np.bincount(q[reached <= FIRST_LOOK], minlength=n))
            q1 = np.flatnonzero(j < many)
            q1 = q1[(ends(q1, j[q1]) * b.mean < ends(q1, many[q1])) & (ends(q1, j[q1]) <= BATCH_LOOK)]
            left, least = np.zeros(n), np.full(n, self.floor)
            left[q1] = rest[first[q1] + j[q1]]
            if len(q1):
                of, some, score, out = self._met(q1, j[q1], left, least)
                of, some, score, got, last = self._best(of, some, score, n)
                q1 = np.setdiff1d(q1, out)
                most1 = most[first[q1] + j[q1]]
                done = (most1 <= self.floor) | ((got[q1] == self.k) & (most1 < last[q1]))
                self._take(found, q1[done], of, some, score, got)
                # the second look: as many terms as it takes for the others not to reach these, and some more
                q2 = q1[~done & (got[q1] == self.k)]
                least[q2] = last[q2]
                j2 = np.bincount(q[most >= least[q]], minlength=n)[q2]
                total = ends(q2, many[q2])
                inside = np.minimum(MORE * ends(q2, j2), (total - 1) // 4)
                limit = np.full(n, -1)
                limit[q2] = inside
                j2 = np.maximum(j2, np.bincount(q[reached <= limit[q]], minlength=n)[q2])
                fit = (j2 < many[q2]) & (ends(q2, j2) * 4 < total) & (ends(q2, j2) <= BATCH_LOOK)
                q2, j2 = q2[fit], j2[fit]
                left[q2] = rest[first[q2] + j2]
                if len(q2):
                    of, some, score, out = self._met(q2, j2, left, least)
                    of, some, score, got, last = self._best(of, some, score, n)
                    self._take(found, np.setdiff1d(q2, out), of, some, score, got)
            self.code[distinct] = 0
        start = np.cumsum(size) - size
        return [b.top(term[s : s + m], factor[s : s + m], self.k, self.floor) if x is None else x for x, s, m in zip(found, start, size)]

    @staticmethod
    def _take(found: list, queries: np.ndarray, of: np.ndarray, some: np.ndarray, score: np.ndarray, got: np.ndarray) -> None:
        last = np.cumsum(got)
        for q in queries.tolist():
            found[q] = some[last[q] - got[q] : last[q]], score[last[q] - got[q] : last[q]]


def _flat(x: pa.Table, numbers: bool = True) -> tuple:
    """Sizes, terms and weights of rows of vectors, end to end; terms as they are unless they are numbers."""
    plain = lambda a: a.to_numpy(zero_copy_only=False)
    t, w = (pa.concat_arrays(x[c].chunks) for c in ("t", "w"))
    return plain(pc.list_value_length(t)), plain(t.flatten()) if numbers else t.flatten(), plain(w.flatten())


def _block_top(k: int, floor: float):
    """Scores of a block of queries against a block of reference records; no pair leaves but each query's k best."""
    kind = pa.schema([("query_id", pa.string()), ("s1_id", pa.string()), ("score", pa.float64())])

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        if not q.num_rows or not p.num_rows:
            return kind.empty_table()
        p = p.sort_by("s1_id")  # in order of ids, which decides ties
        block = Block(*_flat(p))
        size, term, factor = _flat(q)
        last = np.cumsum(size)
        batch, found = Batch(block, k, floor), []
        for a in range(0, len(size), BATCH):
            b = min(a + BATCH, len(size))
            mine = slice(last[a] - size[a], last[b - 1])
            found += batch.top(size[a:b], term[mine], factor[mine])
        mine = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
        code, score = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_arrays([q["query_id"].take(pa.array(mine)).cast(pa.string()), p["s1_id"].take(pa.array(code)).cast(pa.string()), pa.array(score)], schema=kind)

    return run


def search(query: DataFrame, reference: DataFrame, k: int, floor: float = FLOOR) -> DataFrame:
    """(query_id, s1_id, score, rank) by sparse dot product; query: (query_id, t, w), reference: (s1_id, t, w), as vectors() gives them.

    Both sides are written once (writers.kept), so that they are counted without being made again and nothing stays in the
    session's memory. Then both are dealt in blocks of bounded size, and every block of queries meets every block of reference
    records in a task of its own, which gives out k rows a query. Tasks are dealt by number: by hash some get several pairs of
    blocks and others none. A join on terms would give out a row for each shared term of each pair first, and its hottest terms
    would decide the time.
    """
    cores = query.sparkSession.sparkContext.defaultParallelism
    reference, query = writers.kept(reference, "postings"), writers.kept(query, "query-terms")
    terms = lambda df: df.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()[0]
    nq = terms(query)
    rb = max(1, -(-terms(reference) // POSTINGS_BLOCK))
    qb = max(1, -(-nq // QUERY_BLOCK), min(-(-cores // rb), nq // LEAST_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = query.select("query_id", "t", "w", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("a"), each(rb).alias("b"))
    p = reference.select("s1_id", "t", "w", each(qb).alias("a"), F.pmod(F.xxhash64("s1_id"), F.lit(rb)).cast("int").alias("b"))
    tasks = min(TASKS, qb * rb)
    task = F.pmod(F.col("a").cast("bigint") * rb + F.col("b"), F.lit(tasks)).cast("int")
    dealt = lambda df: df.withColumn("task", task).repartitionById(tasks, F.col("task")).groupBy("task", "a", "b")
    found = dealt(q).cogroup(dealt(p)).applyInArrow(_block_top(k, floor), "query_id string, s1_id string, score double")
    return top(found, k, floor)


def top(scored: DataFrame, k: int, floor: float = FLOOR, score: str = "score") -> DataFrame:
    """Ranks 1..k within each query of scores over the floor."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "s1_id")
    return scored.where(F.col(score) > floor).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def boundary_grams(c: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams within words that a space pads on both sides; a word shorter than n gives itself once, padded."""

    def of(word: Column, n: int) -> Column:
        x = F.concat(F.lit(" "), word, F.lit(" "))
        return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, n)))

    def shorter(word: Column) -> Column:
        """n-grams stop with the first n that exceeds the padded word, which is then given once."""
        x = F.concat(F.lit(" "), word, F.lit(" "))
        parts = [F.coalesce(of(word, n), F.array().cast("array<string>")) for n in range(least, most + 1)]
        return F.when(F.length(x) < least, F.array(x)).otherwise(F.concat(*parts))

    return F.flatten(F.transform(text.words(F.lower(c)), shorter))


def word_grams(word: str, least: int = 3, most: int = 5) -> list[str]:
    """boundary_grams of one word."""
    x = f" {word} "
    return [x] if len(x) < least else [x[i : i + n] for n in range(least, most + 1) for i in range(len(x) - n + 1)]


def gram_words(records: DataFrame, column: str, id_as: str) -> DataFrame:
    """(id, words): a row for each id that has words."""
    words = F.flatten(F.collect_list(text.words(F.lower(F.col(column)))))
    return records.groupBy(F.col("entity_id").alias(id_as)).agg(words.alias("words")).where(F.size("words") > 0)


def _grams(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of rows of words: numbers of different n-grams, then these and 1 + ln of their counts end to end."""
    made = [Counter(g for w in row for g in word_grams(w)) for row in words.to_pylist()]
    number = np.fromiter((n for c in made for n in c.values()), float)
    return np.fromiter(map(len, made), int), pa.array([g for c in made for g in c], pa.string()), 1 + np.log(number)


def _lists(size: np.ndarray, *flat) -> list[pa.Array]:
    """Values end to end as arrays of so many a row."""
    ends = pa.array(np.append(0, np.cumsum(size)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat]


def gram_counts(records: DataFrame, column: str, id_as: str) -> DataFrame:
    """(id, term, tf): a row for each id, its n-grams and 1 + ln of their counts. Counted within a row, so that none is shuffled."""
    rows = gram_words(records, column, id_as)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[id_as], *_lists(*_grams(b["words"]))], names=[id_as, "term", "tf"])

    return rows.mapInArrow(run, f"{id_as} {dict(rows.dtypes)[id_as]}, term array<string>, tf array<double>")


def gram_totals(rows: DataFrame) -> DataFrame:
    """(term, df, cf) of the n-grams of rows (id, words), added up by batches before they are shuffled."""

    def run(batches):
        for b in batches:
            _, term, tf = _grams(b["words"])
            got = pa.table({"term": term, "cf": tf}).group_by("term", use_threads=False).aggregate([("cf", "count"), ("cf", "sum")])
            yield from got.select(["term", "cf_count", "cf_sum"]).rename_columns(["term", "df", "cf"]).to_batches()

    return rows.mapInArrow(run, "term string, df bigint, cf double").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def tfidf_vectors(reference: DataFrame, query: DataFrame, column: str, min_df: int = 2, max_features: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of character n-grams, (query_id, t, w) and (s1_id, t, w). The vocabulary, max_features terms at most, goes to every task.

    Words are written once and n-grams, many times as long, made of them where they are counted. Reference vectors leave out, once they
    have their length, the terms that no query has: these add nothing to any product.
    """
    asks, rows = (readers.spread(writers.kept(gram_words(x, column, by), "words")) for x, by in ((query, "query_id"), (reference, "s1_id")))
    n = reference.agg(F.count("*").alias("n"))
    used = gram_totals(rows).where(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_features)
    known = used.join(gram_totals(asks).select("term", F.lit(True).alias("asked")), "term", "left").join(F.broadcast(n))
    known = known.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), F.coalesce("asked", F.lit(False)).alias("asked")).toPandas()
    terms, idf, asked = pa.array(known.term, pa.string()), known.idf.to_numpy(float), known.asked.to_numpy(bool)

    def unit(x: DataFrame, by: str) -> DataFrame:
        def run(batches):
            for b in batches:
                size, term, tf = _grams(b["words"])
                t = pc.fill_null(pc.index_in(term, value_set=terms), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)[t >= 0]
                t, tf = t[t >= 0], tf[t >= 0]
                w = tf * idf[t]
                w = w / np.sqrt(np.bincount(row, weights=w * w, minlength=len(size)))[row]
                row, t, w = row[asked[t]], t[asked[t]], w[asked[t]]
                yield pa.RecordBatch.from_arrays([b[by], *_lists(np.bincount(row, minlength=len(size)), t.astype(np.int32), w)], names=[by, "t", "w"])

        return x.mapInArrow(run, f"{by} {dict(x.dtypes)[by]}, t array<int>, w array<double>").where(F.size("t") > 0)

    return unit(asks, "query_id"), unit(rows, "s1_id")


def tfidf_top(reference: DataFrame, query: DataFrame, column: str, k: int, min_df: int = 2, max_features: int = 100_000) -> DataFrame:
    """Cosine of character n-gram vectors: (query_id, s1_id, score, rank)."""
    return search(*tfidf_vectors(reference, query, column, min_df, max_features), k)


#: A block of queries meets a block of reference rows CHUNK rows at a time: a matrix of at most 64 MB.
DENSE_QUERIES, DENSE_ROWS, DENSE_CHUNK, DENSE_LEAST = 2048, 65_536, 4096, 1024


def _best(mine: np.ndarray, code: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k greatest scores, ties by code."""
    order = np.lexsort((code, -score, mine))
    first = np.searchsorted(mine[order], mine[order])
    return order[np.arange(len(order)) - first < k]


def _dense_block(k: int, floor: float):
    """Dot products of a block of queries and a block of reference rows of one length; no pair leaves but each query's k best."""

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": q.query_id[:0], "s1_id": r.s1_id[:0], "score": pd.Series(dtype=float)})
        r = r.sort_values("s1_id", ignore_index=True)  # in order of ids, which decides ties
        left = np.stack(q.q.to_numpy()).astype(np.float64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(r), DENSE_CHUNK):
            right = np.stack(r.v[at : at + DENSE_CHUNK].to_numpy()).astype(np.float64)
            score = np.round(left @ right.T, DIGITS)
            least = np.partition(score, -k, axis=1)[:, -k, None] if right.shape[0] > k else -np.inf
            mine, code = np.nonzero((score >= least) & (score > floor))
            some = _best(mine, code, score[mine, code], k)
            held.append((mine[some], code[some] + at, score[mine[some], code[some]]))
        mine, code, score = (np.concatenate(x) for x in zip(*held))
        some = _best(mine, code, score, k)
        return pd.DataFrame({"query_id": q.query_id.to_numpy()[mine[some]], "s1_id": r.s1_id.to_numpy()[code[some]], "score": score[some]})

    return run


def dense_top(query: DataFrame, reference: DataFrame, k: int, floor: float = 0.0) -> DataFrame:
    """Dot-product top k of a stated query set (query_id, q) against all rows (s1_id, v): (query_id, s1_id, score, rank).

    Both sides are dealt in blocks of bounded size; every block of queries meets every block of reference rows as a matrix
    product in a task of its own, which gives out k rows a query. Vectors of different lengths never meet; rows of a null id
    and null or empty vectors, or those that hold a null, meet nothing. Rows that repeat an id are rows of their own.
    """
    usable = lambda df, i, c: df.where(F.col(i).isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull())).withColumn("n", F.size(c))
    query, reference = usable(query, "query_id", "q"), usable(reference, "s1_id", "v")
    cores = query.sparkSession.sparkContext.defaultParallelism
    rows = reference.count()
    qb = max(1, -(-query.count() // DENSE_QUERIES))
    rb = max(1, -(-rows // DENSE_ROWS), min(cores, rows // DENSE_LEAST))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = query.select("query_id", "q", "n", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("a"), each(rb).alias("b"))
    r = reference.select("s1_id", "v", "n", each(qb).alias("a"), F.pmod(F.xxhash64("s1_id", "v"), F.lit(rb)).cast("int").alias("b"))
    types = dict(query.dtypes) | dict(reference.dtypes)
    found = q.groupBy("n", "a", "b").cogroup(r.groupBy("n", "a", "b")).applyInPandas(_dense_block(k, floor), f"query_id {types['query_id']}, s1_id {types['s1_id']}, score double")
    return top(found, k, floor)
