"""Equi-join blocking channels. A channel is a key table on either side; none collects a bucket.

Outputs are (query_id, s1_id). Keys that are null or empty never match. `first` orders reference records within a bucket
(file order in files; here any unique column).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phonetics, text

PERMUTATIONS, BANDS, PRIME, SEED = 64, 16, 2**31 - 1, 42


def keyed(records: DataFrame, key: Column, id_as: str, least: int = 1, *more: str) -> DataFrame:
    """(id_as, key, more) of records with a key of `least` characters or more."""
    return records.select(F.col("entity_id").alias(id_as), key.alias("key"), *more).where(F.length("key") >= least)


def digest_keyed(records: DataFrame, keys: dict[str, Column], id_as: str, least: int = 1) -> DataFrame:
    """(id_as, channel, key): several keys of a record in one pass; long keys travel as digests, of which only equality counts."""
    made = F.array(*(F.struct(F.lit(n).alias("channel"), k.alias("key")) for n, k in keys.items()))
    rows = records.select(F.col("entity_id").alias(id_as), F.explode(made).alias("k")).select(id_as, "k.channel", "k.key").where(F.length("key") >= least)
    return rows.withColumn("key", F.concat("channel", F.lit(":"), F.when(F.length("key") > 64, F.sha2("key", 256)).otherwise(F.col("key"))))


def exact_channels(reference: DataFrame, query: DataFrame, keys: dict[str, Column], cap: int = 100) -> DataFrame:
    """(query_id, s1_id, channel): exact() over several keys at once, each side scanned once."""
    r, q = digest_keyed(reference, keys, "s1_id", 2), digest_keyed(query, keys, "query_id", 2)
    return exact(r.drop("channel"), q, cap, "channel")


def exact(reference: DataFrame, query: DataFrame, cap: int = 100, *more: str) -> DataFrame:
    """Pairs of equal keys; a key with over `cap` different reference ids gives none. Sides as keyed() with id s1_id, query_id.

    Oversize keys are found by a partial aggregate and dropped from the reference side, so the join itself meets at most `cap`
    rows of a key there.
    """
    sizes = reference.groupBy("key").agg(F.countDistinct("s1_id").alias("n")).where(F.col("n") <= cap).select("key")
    usable = reference.join(sizes, "key", "left_semi").distinct()
    return query.join(usable, "key").select("query_id", "s1_id", *more).distinct()


def first_of_bucket(reference: DataFrame, cap: int = 20, first: str = "first") -> DataFrame:
    """Of each key the first `cap` reference rows; the limit is taken before the shuffle too."""
    w = Window.partitionBy("key").orderBy(first)
    return reference.withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap)


def truncated(reference: DataFrame, query: DataFrame, cap: int = 20, first: str = "first") -> DataFrame:
    """Pairs of equal keys with the first `cap` reference records of each key."""
    return query.join(first_of_bucket(reference, cap, first), "key").groupBy("query_id", "s1_id").agg(F.min("position").alias("position"))


def unique_key(reference: DataFrame, query: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of keys held by one reference record, query rows left without)."""
    once = reference.groupBy("key").agg(F.count("*").alias("n"), F.min("s1_id").alias("s1_id")).where("n = 1")
    pairs = query.join(once, "key").select("query_id", "s1_id")
    return pairs, query.join(pairs.select("query_id"), "query_id", "left_anti")


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[list[int], list[int]]:
    rng = np.random.RandomState(seed)
    return rng.randint(1, PRIME, size=n, dtype=np.int64).tolist(), rng.randint(0, PRIME, size=n, dtype=np.int64).tolist()


def band_keys(ids: Column, bands: int = BANDS, n: int = PERMUTATIONS) -> Column:
    """Array of one key a band: its number and its rows of the MinHash signature; null without ids."""
    a, b = permutations(n)
    rows = n // bands
    least = lambda i: F.array_min(F.transform(ids, lambda x: (x * F.lit(a[i]) + F.lit(b[i])) % PRIME))
    sign = [least(i) for i in range(n)]
    keys = [F.concat_ws(":", F.lit(str(k)), *(s.cast("string") for s in sign[k * rows : (k + 1) * rows])) for k in range(bands)]
    return F.when(F.size(ids) > 0, F.array(*keys))


def lsh_rows(records: DataFrame, column: str, id_as: str, *more: str) -> DataFrame:
    """(id, key, more) with a row for each band of a text's signature."""
    grams = records.select(F.col("entity_id").alias(id_as), F.array_distinct(text.gram_ids(F.col(column))).alias("g"), *more)
    return grams.select(id_as, F.explode(band_keys(F.col("g"))).alias("key"), *more)


def phonetic_rows(records: DataFrame, column: str, id_as: str, *more: str) -> DataFrame:
    return phonetics.with_keys(records.select(F.col("entity_id").alias(id_as), F.col(column), *more), column).select(id_as, "key", *more)


def token_rows(records: DataFrame, column: str, id_as: str, most: int, *more: str) -> DataFrame:
    """(id, key, more): the first `most` words of four characters or more."""
    long = F.filter(text.words(F.col(column)), lambda w: F.length(w) >= 4)
    return records.select(F.col("entity_id").alias(id_as), F.explode(F.slice(long, 1, most)).alias("key"), *more).distinct()


def sparse_token(reference_rows: DataFrame, query_rows: DataFrame, so_far: DataFrame, least: int = 3, cap: int = 20) -> DataFrame:
    """Token pairs, only for queries with fewer than `least` candidates so far."""
    served = so_far.groupBy("query_id").agg(F.countDistinct("s1_id").alias("n")).where(F.col("n") >= least).select("query_id")
    return truncated(reference_rows, query_rows.join(served, "query_id", "left_anti"), cap)


def country_block(pairs: DataFrame, query: DataFrame, reference: DataFrame) -> DataFrame:
    """Pairs but those whose countries are both given and differ. Comes after ranking, so ranks keep their gaps."""
    fold = lambda c: F.lower(text.strip(c))
    q = query.select(F.col("entity_id").alias("query_id"), fold("country").alias("__q"))
    s = reference.select(F.col("entity_id").alias("s1_id"), fold("country").alias("__s"))
    return pairs.join(q, "query_id").join(s, "s1_id").where("__q = '' OR __s = '' OR __q = __s").drop("__q", "__s")
