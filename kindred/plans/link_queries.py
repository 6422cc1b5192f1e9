"""Queries of blocking joins, retrieval, candidate merging and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import blocking, candidates, retrieval
from ..sources import readers
from . import sql
from .pair_queries import hybrid_candidates, party_pairs, party_sides
from .text_queries import sides

K = 5


def _keys(ref: DataFrame, query: DataFrame, c, least: int = 1) -> tuple[DataFrame, DataFrame]:
    return blocking.keyed(ref, c, "s1_id", least, F.col("doc_id").alias("first")), blocking.keyed(query, c, "query_id", least)


def j1_exact_capped(spark: SparkSession, d: str) -> DataFrame:
    """Names, addresses and both; keys over the cap give nothing."""
    ref, query, _ = sides(spark, d)
    return blocking.exact_channels(ref, query, _three(), 30)


def _three() -> dict:
    name, addr = text.normalize("business_name"), text.normalize("business_address")
    return {"name": name, "address": addr, "combined": text.join_fields(name, addr)}


def j2_truncated(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = sides(spark, d)
    return blocking.truncated(*_keys(ref, query, text.normalize("business_name")), 3).select("query_id", "s1_id")


def j3_unique_key(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = sides(spark, d)
    r, q = _keys(ref, query, text.join_fields(text.normalize("business_name"), text.normalize("business_address")))
    return blocking.unique_key(r, q)[0]


def p1_country_block(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one first word, where countries allow."""
    ref, query, _ = sides(spark, d)
    first = F.substring_index(text.normalize("business_name"), " ", 1)
    pairs = blocking.truncated(*_keys(ref, query, first), 5).select("query_id", "s1_id")
    return blocking.country_block(pairs, query, ref)


def _bm25(spark: SparkSession, d: str, mode: retrieval.Bm25) -> DataFrame:
    ref, query, _ = sides(spark, d)
    forms = lambda df: df.select("entity_id", text.transliterate("business_name").alias("t"))
    return retrieval.bm25_top(forms(ref), forms(query), "t", K, mode)


def j4_bm25_main(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, retrieval.MAIN)


def j4b_bm25_sieve(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, retrieval.SIEVE)


def j4c_bm25_late(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, retrieval.LATE)


def j5_tfidf(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = party_sides(spark, d)
    return retrieval.tfidf_top(ref, query, "business_name", K)


def j6_minhash_lsh(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = sides(spark, d)
    name = text.normalize("business_name")
    r, q = ref.withColumn("n", name).withColumn("first", F.col("doc_id")), query.withColumn("n", name)
    return blocking.truncated(blocking.lsh_rows(r, "n", "s1_id", "first"), blocking.lsh_rows(q, "n", "query_id")).select("query_id", "s1_id")


def j7_phonetic(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = sides(spark, d)
    name = text.transliterate("business_name")
    r, q = ref.withColumn("n", name).withColumn("first", F.col("doc_id")), query.withColumn("n", name)
    return blocking.truncated(blocking.phonetic_rows(r, "n", "s1_id", "first"), blocking.phonetic_rows(q, "n", "query_id")).select("query_id", "s1_id")


def j8_token(spark: SparkSession, d: str) -> DataFrame:
    """Token pairs of queries with fewer than three exact-name candidates."""
    ref, query, _ = sides(spark, d)
    name = text.normalize("business_name")
    r, q = ref.withColumn("n", name).withColumn("first", F.col("doc_id")), query.withColumn("n", name)
    so_far = blocking.truncated(*_keys(ref, query, name)).select("query_id", "s1_id")
    return blocking.sparse_token(blocking.token_rows(r, "n", "s1_id", 3, "first"), blocking.token_rows(q, "n", "query_id", 2), so_far).select("query_id", "s1_id")


def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = sides(spark, d)
    found = blocking.exact_channels(ref, query, _three(), 30)
    channels = {f"exact_{c}": found.where(F.col("channel") == c).drop("channel") for c in ("name", "address", "combined")}
    forms = lambda df: df.select("entity_id", text.transliterate("business_name").alias("t"))
    channels["bm25_name"] = retrieval.bm25_top(forms(ref), forms(query), "t", K)
    return blocking.country_block(candidates.merged(channels), query, ref)


def j9_merged(spark: SparkSession, d: str) -> DataFrame:
    return merged_candidates(spark, d).select("query_id", "s1_id", "by_exact_name", "by_exact_address", "by_exact_combined", "by_bm25_name", "bm25_name_score", "bm25_name_rank", "retrieval_agreement_count", "best_retrieval_rank", F.round("best_reciprocal_rank", 6).alias("best_reciprocal_rank"))


def j10_hybrid(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = party_sides(spark, d)
    return hybrid_candidates(ref, query)


def _filled(spark: SparkSession, d: str, keys, fixed, mode, k: int) -> DataFrame:
    ref, query, _ = sides(spark, d)
    channels = [(blocking.truncated(*_keys(ref, query, c), 20), s) for c, s in zip(keys, fixed)]
    forms = lambda df: df.select("entity_id", text.transliterate("business_name").alias("t"))
    channels.append((retrieval.bm25_top(forms(ref), forms(query), "t", k, mode), None))
    return candidates.priority_fill(channels, k)


def j11_priority_fill(spark: SparkSession, d: str) -> DataFrame:
    """Names (10), addresses (8), then retrieval while there are fewer than 8."""
    return _filled(spark, d, (text.normalize("business_name"), text.normalize("business_address")), (10.0, 8.0), retrieval.SIEVE, 8)


def j12_priority_fill_late(spark: SparkSession, d: str) -> DataFrame:
    """Combined fields first, then names and addresses, then retrieval while there are fewer than 10."""
    name, addr = text.normalize("business_name"), text.normalize("business_address")
    return _filled(spark, d, (F.concat_ws(" ", name, addr), name, addr), (10.0, 9.0, 8.0), retrieval.LATE, 10)


def j16_injected(spark: SparkSession, d: str) -> DataFrame:
    ref, query, edges = party_sides(spark, d)
    near = blocking.truncated(blocking.keyed(ref, F.col("business_address"), "s1_id", 1, F.col("key").alias("first")), blocking.keyed(query, F.concat_ws(" ", "business_address", F.lit("BUILDING")), "query_id"), 2)
    return candidates.inject(near.select("query_id", "s1_id", F.lit(0).alias("injected")), edges, injected=1)


def j17_dense_top(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector as a query against all."""
    e = readers.table(spark, d, "embeddings")
    return retrieval.dense_top(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("s1_id"), F.col("embedding").alias("v")), 10)


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = readers.table(spark, d, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


def j18_pairwise_dot(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("vec_id", F.round(vectors.dot(F.col("a"), F.col("b")), 5).alias("dot"))


def f12_maxsim(spark: SparkSession, d: str) -> DataFrame:
    """Late interaction of vectors cut into eight token vectors of eight, and the calibrated head."""
    s = vectors.maxsim(vectors.slices(F.col("a"), 8, 8), vectors.slices(F.col("b"), 8, 8))
    return _neighbours(spark, d).select("vec_id", F.round(s, 5).alias("maxsim"), F.round(vectors.calibrated(s, 0.1, 0.05), 4).alias("p"))


def a1_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and count of the words of whole documents."""
    docs = readers.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), text.normalize("text").alias("t"))
    return retrieval.tokens(docs, "t", "id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def a2_candidate_stats(spark: SparkSession, d: str) -> DataFrame:
    ref, query, edges = party_sides(spark, d)
    return candidates.stats(party_pairs(ref, query, edges))


QUERIES = {f.__name__: f for f in (j1_exact_capped, j2_truncated, j3_unique_key, p1_country_block, j4_bm25_main, j4b_bm25_sieve, j4c_bm25_late, j5_tfidf, j6_minhash_lsh, j7_phonetic, j8_token, j9_merged, j10_hybrid, j11_priority_fill, j12_priority_fill_late, j16_injected, j17_dense_top, j18_pairwise_dot, f12_maxsim, a1_term_stats, a2_candidate_stats)}

# names and addresses normalised once; t is the Latin name
_S = f"""WITH {sql.SIDES},
r AS (SELECT entity_id AS s1_id, doc_id, country, {sql.norm("business_name")} AS n, {sql.norm("business_address")} AS a, {sql.latin("business_name")} AS t FROM ref),
q AS (SELECT entity_id AS query_id, doc_id, country, {sql.norm("business_name")} AS n, {sql.norm("business_address")} AS a, {sql.latin("business_name")} AS t FROM qry)"""


def _exact_sql(key: str, cap: int = 30) -> str:
    return f"SELECT query_id, s1_id FROM (SELECT {key} AS k, s1_id, count(*) OVER (PARTITION BY {key}) AS c FROM r WHERE length({key}) >= 2) x JOIN (SELECT {key} AS k, query_id FROM q) y USING (k) WHERE c <= {cap}"


def _trunc_sql(key: str, cap: int) -> str:
    return f"SELECT query_id, s1_id, rn FROM (SELECT {key} AS k, s1_id, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) AS rn FROM r WHERE length({key}) >= 1) x JOIN (SELECT {key} AS k, query_id FROM q) y USING (k) WHERE rn <= {cap}"


def _bm25_sql(mode: retrieval.Bm25, k: int, name: str = "bm") -> str:
    stop = f"WHERE term NOT IN ({', '.join(repr(w) for w in sorted(set(mode.stop_words)))})" if mode.stop_words else ""
    limit = f"WHERE df <= {mode.max_df} * (SELECT n FROM {name}n) OR (SELECT n FROM {name}n) < {mode.small}"
    idf = "ln((n - df + 0.5) / (df + 0.5) + 1)"
    idf = f"greatest({idf}, 0)" if mode.floor_idf else idf
    return f"""{name}n AS (SELECT count(*) AS n FROM r),
{name}rt AS (SELECT s1_id, term, count(*) AS tf FROM (SELECT s1_id, unnest({sql.terms("lower(t)")}) AS term FROM r) GROUP BY ALL),
{name}qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({sql.terms("lower(t)")}) AS term FROM q) GROUP BY ALL),
{name}v AS (SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM {name}rt {stop} GROUP BY term) {limit} ORDER BY cf DESC, term LIMIT {mode.max_features}),
{name}i AS (SELECT * FROM {name}rt JOIN {name}v USING (term)),
{name}l AS (SELECT s1_id, sum(tf) AS len FROM {name}i GROUP BY s1_id),
{name}w AS (SELECT term, s1_id, tf * {mode.k1 + 1} / (tf + {mode.k1} * (1 - {mode.b} + {mode.b} * len / ((SELECT sum(len) FROM {name}l) / n))) * {idf} AS w FROM {name}i JOIN {name}l USING (s1_id), {name}n),
{name}s AS (SELECT query_id, s1_id, round(sum({"tf * w" if mode.query_tf else "w"}), 6) AS score FROM {name}qt JOIN {name}w USING (term) GROUP BY ALL),
{name} AS (SELECT query_id, s1_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s1_id) AS rank FROM {name}s WHERE score > {retrieval.FLOOR} QUALIFY rank <= {k})"""


def _fill_sql(channels: list[tuple[str, float]], mode: retrieval.Bm25, k: int) -> str:
    parts = [f"SELECT query_id, s1_id, {i} AS p, rn AS w, {s}::DOUBLE AS score FROM ({_trunc_sql(key, 20)})" for i, (key, s) in enumerate(channels)]
    parts.append(f"SELECT query_id, s1_id, {len(channels)}, rank, score FROM bm")
    return f"""{_S}, {_bm25_sql(mode, k)}, u AS ({" UNION ALL ".join(parts)}),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, s1_id ORDER BY p, w, score) = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, w, s1_id) AS rank FROM f) SELECT query_id, s1_id, score, rank FROM g WHERE p = 0 OR rank <= {k}"""


def _minhash_sql() -> str:
    a, b = blocking.permutations()
    perm = ", ".join(f"({i}, {x}::BIGINT, {y}::BIGINT)" for i, (x, y) in enumerate(zip(a, b)))
    grams = "CASE WHEN length(n) < 3 THEN list_filter([n], lambda w: w <> '') ELSE list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3)) END"
    rows = blocking.PERMUTATIONS // blocking.BANDS
    keys = lambda t, i: f"SELECT {i}, doc_id, i // {rows} AS band, string_agg(m, ':' ORDER BY i) AS k FROM (SELECT {i}, doc_id, i, min((a * x + b) % {blocking.PRIME}) AS m FROM (SELECT DISTINCT {i}, doc_id, (('0x' || substr(md5(g), 1, 8))::BIGINT & 2147483647) AS x FROM (SELECT {i}, doc_id, unnest({grams}) AS g FROM {t})), perm GROUP BY {i}, doc_id, i) GROUP BY ALL"
    return f"""{_S}, perm(i, a, b) AS (VALUES {perm}), rk AS ({keys("r", "s1_id")}), qk AS ({keys("q", "query_id")})
SELECT DISTINCT query_id, s1_id FROM qk JOIN (SELECT *, row_number() OVER (PARTITION BY band, k ORDER BY doc_id) AS rn FROM rk) x USING (band, k) WHERE rn <= 20"""


def _tfidf_sql(k: int) -> str:
    """Tables over ref and qry, the last of them tf."""
    pad = "' ' || w || ' '"
    grams = f"list_concat({', '.join(f'list_transform(range(1, length({pad}) - {n - 2}), lambda i: substr({pad}, i, {n}))' for n in (3, 4, 5))})"
    rows = lambda t, i: f"SELECT {i}, term, 1 + ln(count(*)) AS tf FROM (SELECT {i}, unnest({grams}) AS term FROM (SELECT entity_id AS {i}, unnest({sql.words('lower(business_name)')}) AS w FROM {t})) GROUP BY ALL"
    unit = lambda t, i: f"SELECT {i}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {i})) AS w FROM (SELECT {i}, term, tf * idf AS w FROM {t} JOIN idf USING (term))"
    return f"""rt AS ({rows("ref", "s1_id")}), qt AS ({rows("qry", "query_id")}),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM ref)) / (1 + count(*))) + 1 AS idf FROM rt GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 100000),
ru AS ({unit("rt", "s1_id")}), qu AS ({unit("qt", "query_id")}), ts AS (SELECT query_id, s1_id, round(sum(ru.w * qu.w), 6) AS score FROM ru JOIN qu USING (term) GROUP BY ALL),
tf AS (SELECT query_id, s1_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s1_id) AS rank FROM ts WHERE score > {retrieval.FLOOR} QUALIFY rank <= {k})"""


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NEXT = "WITH n AS (SELECT x.vec_id, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
_COMBINED = "trim(n || ' ' || a)"
_LONG = "list_filter({}, lambda w: length(w) >= 4)"
ORACLE = {
    "j1_exact_capped": f"{_S} " + " UNION ALL ".join(f"SELECT *, '{c}' AS channel FROM ({_exact_sql(k)})" for c, k in (("name", "n"), ("address", "a"), ("combined", _COMBINED))),
    "j2_truncated": f"{_S} SELECT query_id, s1_id FROM ({_trunc_sql('n', 3)})",
    "j3_unique_key": f"{_S} SELECT query_id, s1_id FROM (SELECT {_COMBINED} AS k, query_id FROM q WHERE {_COMBINED} <> '') JOIN (SELECT {_COMBINED} AS k, min(s1_id) AS s1_id FROM r GROUP BY k HAVING count(*) = 1) USING (k)",
    "p1_country_block": f"{_S} SELECT query_id, s1_id FROM ({_trunc_sql("split_part(n, ' ', 1)", 5)}) p JOIN q USING (query_id) JOIN r USING (s1_id) WHERE lower(q.country) = lower(r.country) OR q.country = '' OR r.country = ''",
    "j4_bm25_main": f"{_S}, {_bm25_sql(retrieval.MAIN, K)} SELECT * FROM bm",
    "j4b_bm25_sieve": f"{_S}, {_bm25_sql(retrieval.SIEVE, K)} SELECT * FROM bm",
    "j4c_bm25_late": f"{_S}, {_bm25_sql(retrieval.LATE, K)} SELECT * FROM bm",
    "j5_tfidf": f"WITH {sql.PAIRS}, {_tfidf_sql(K)} SELECT * FROM tf",
    "j6_minhash_lsh": _minhash_sql(),
    "j8_token": f"""{_S}, done AS (SELECT query_id FROM ({_trunc_sql("n", 20)}) GROUP BY 1 HAVING count(*) >= 3),
        rt AS (SELECT DISTINCT s1_id, doc_id, unnest(({_LONG.format(sql.words("n"))})[1:3]) AS k FROM r), qt AS (SELECT DISTINCT query_id, unnest(({_LONG.format(sql.words("n"))})[1:2]) AS k FROM q WHERE query_id NOT IN (SELECT query_id FROM done))
        SELECT DISTINCT query_id, s1_id FROM qt JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rn FROM rt) USING (k) WHERE rn <= 20""",
    "j9_merged": f"""{_S}, {_bm25_sql(retrieval.MAIN, K)}, u AS (SELECT *, 'n' AS c, 0.0 AS score, 999 AS rank FROM ({_exact_sql("n")}) UNION ALL SELECT *, 'a', 0.0, 999 FROM ({_exact_sql("a")}) UNION ALL SELECT *, 'c', 0.0, 999 FROM ({_exact_sql(_COMBINED)})
          UNION ALL SELECT query_id, s1_id, 'b', score, rank FROM bm),
        m AS (SELECT query_id, s1_id, max((c = 'n')::INT) AS by_exact_name, max((c = 'a')::INT) AS by_exact_address, max((c = 'c')::INT) AS by_exact_combined, max((c = 'b')::INT) AS by_bm25_name, max(score)::DOUBLE AS bm25_name_score, min(rank) AS bm25_name_rank FROM u GROUP BY ALL)
        SELECT m.*, by_exact_name + by_exact_address + by_exact_combined + by_bm25_name AS retrieval_agreement_count, bm25_name_rank AS best_retrieval_rank, round(CASE WHEN bm25_name_rank < 999 THEN 1 / bm25_name_rank ELSE 0 END, 6) AS best_reciprocal_rank
        FROM m JOIN q USING (query_id) JOIN r USING (s1_id) WHERE q.country = '' OR r.country = '' OR lower(q.country) = lower(r.country)""",
    "j11_priority_fill": _fill_sql([("n", 10.0), ("a", 8.0)], retrieval.SIEVE, 8),
    "j12_priority_fill_late": _fill_sql([("(n || ' ' || a)", 10.0), ("n", 9.0), ("a", 8.0)], retrieval.LATE, 10),
    "j16_injected": f"""WITH {sql.PAIRS}, near AS (SELECT q.entity_id AS query_id, s1_id FROM (SELECT entity_id AS s1_id, business_address AS k, row_number() OVER (PARTITION BY business_address ORDER BY key) AS rn FROM ref) x JOIN qry q ON k = q.business_address || ' BUILDING' WHERE rn <= 2)
        SELECT query_id, s1_id, 0 AS injected FROM near UNION ALL SELECT query_id, s1_id, 1 FROM truth WHERE (query_id, s1_id) NOT IN (SELECT query_id, s1_id FROM near)""",
    "j17_dense_top": f"""WITH s AS (SELECT x.vec_id AS query_id, y.vec_id AS s1_id, round({_DOT.format("x.embedding", "y.embedding")}, 6) AS score FROM embeddings x, embeddings y WHERE x.vec_id % 100 = 0)
        SELECT query_id, s1_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s1_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "j18_pairwise_dot": f"{_NEXT} SELECT vec_id, round({_DOT.format('a', 'b')}, 5) AS dot FROM n",
    "f12_maxsim": f"""{_NEXT}, t AS (SELECT vec_id, i, max({_DOT.format("a[i * 8 + 1 : i * 8 + 8]", "b[j * 8 + 1 : j * 8 + 8]")}) AS m FROM n, range(8) AS x(i), range(8) AS y(j) GROUP BY ALL), s AS (SELECT vec_id, sum(m) / 8 AS s FROM t GROUP BY 1)
        SELECT vec_id, round(s, 5) AS maxsim, round(1 / (1 + exp(-(s - 0.1) / 0.05)), 4) AS p FROM s""",
    "a1_term_stats": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.terms(sql.norm('text'))}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "a2_candidate_stats": f"WITH {sql.PAIRS} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_pairs, round(count(*) / count(DISTINCT query_id), 6) AS pairs_per_query FROM pairs",
}
