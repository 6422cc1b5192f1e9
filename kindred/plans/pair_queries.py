"""Queries of pair predicates, similarities and feature extractors over parties, with their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, tables, text
from ..operators import blocking, candidates, features, retrieval, veto
from ..sources import readers, writers
from . import sql


def party_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers, suppliers, and edges of equal keys."""
    p = readers.parties(spark, d)
    ref, query = readers.reference_side(p), readers.query_side(p)
    edges = query.select(F.col("entity_id").alias("query_id"), "key").join(ref.select(F.col("entity_id").alias("s1_id"), "key"), "key").select("s1_id", "query_id")
    return ref, query, edges


def party_pairs(ref: DataFrame, query: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that share a nation (with its first 20 customers), and true ones."""
    nation = F.regexp_extract("business_address", r"^NATION \d+", 0)
    near = blocking.truncated(blocking.keyed(ref, nation, "s1_id", 1, F.col("key").alias("first")), blocking.keyed(query, nation, "query_id"), 20)
    return near.select("query_id", "s1_id").unionByName(edges).distinct()


def met(spark: SparkSession, d: str) -> DataFrame:
    ref, query, edges = party_sides(spark, d)
    side = lambda df, i, p: df.select(F.col("entity_id").alias(i), F.col("business_name").alias(f"{p}n"), F.col("business_address").alias(f"{p}a"), F.col("country").alias(f"{p}c"))
    return party_pairs(ref, query, edges).join(side(query, "query_id", "q"), "query_id").join(side(ref, "s1_id", "s"), "s1_id")


def whole(p: str) -> Column:
    return F.lower(F.concat_ws(" ", f"{p}n", f"{p}a"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, s1_id, score): edit similarity of name and address."""
    return met(spark, d).select("query_id", "s1_id", F.round(similarity.levenshtein(whole("q"), whole("s")), 6).alias("score"))


def p_veto(spark: SparkSession, d: str) -> DataFrame:
    qa, sa, qc, sc = (F.col(c) for c in ("qa", "sa", "qc", "sc"))
    return met(spark, d).select("query_id", "s1_id", veto.numeric_conflict(qa, sa).alias("numeric"), veto.pin_conflict(qa, sa).alias("pin"), veto.geographic_conflict(qc, sc, qa, sa).alias("geographic"), veto.veto(qa, sa, qc, sc).alias("veto"))


def p5_vetoed_scores(spark: SparkSession, d: str) -> DataFrame:
    qa, sa, qc, sc = (F.col(c) for c in ("qa", "sa", "qc", "sc"))
    x = met(spark, d).select("query_id", "s1_id", F.round(similarity.levenshtein(whole("q"), whole("s")), 6).alias("score"), veto.veto(qa, sa, qc, sc).alias("veto"))
    return veto.apply(x).select("query_id", "s1_id", "score")


def n10_acronym(spark: SparkSession, d: str) -> DataFrame:
    """Each market segment's and region's initials against names made of several words."""
    names = readers.table(spark, d, "part").select("p_name").distinct()
    q = readers.table(spark, d, "part").select(F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), "")).alias("q")).distinct()
    return names.join(q, F.substring(F.upper("p_name"), 1, 1) == F.substring("q", 1, 1)).select("q", "p_name", text.acronym(F.col("q"), F.col("p_name")).alias("is_acronym"))


def n11_distinct_names(spark: SparkSession, d: str) -> DataFrame:
    return met(spark, d).select("query_id", "s1_id", text.distinct_names(text.normalize("qn"), text.normalize("sn")).alias("names"), text.distinct_names(text.normalize("qa"), text.normalize("sa")).alias("addresses"))


def f1_token_metrics(spark: SparkSession, d: str) -> DataFrame:
    q, s = whole("q"), whole("s")
    return met(spark, d).select("query_id", "s1_id", F.round(similarity.token_jaccard(q, s), 6).alias("jaccard"), similarity.token_overlap(q, s).alias("overlap"), similarity.token_diff(q, s).alias("diff"))


def f2_similarity(spark: SparkSession, d: str) -> DataFrame:
    q, s = whole("q"), whole("s")
    return met(spark, d).select("query_id", "s1_id", F.round(similarity.levenshtein(q, s), 6).alias("lev"), F.round(similarity.fuzzy(q, s, "jaro_winkler")["jaro_winkler"], 6).alias("jw"), similarity.length_diff(q, s).alias("len_diff"), F.round(similarity.length_ratio(q, s), 6).alias("len_ratio"))


def f2_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return met(spark, d).withColumn("f", similarity.fuzzy(whole("q"), whole("s"))).select("query_id", "s1_id", "f.*")


def f4_f6_flags(spark: SparkSession, d: str) -> DataFrame:
    """The native flags of the main extractor."""
    ref, query, edges = party_sides(spark, d)
    x = features.facts(party_pairs(ref, query, edges), features.prepared(query), features.prepared(ref))
    cols = features.native_main()
    keep = ("exact_name_raw", "exact_addr_raw", "exact_addr_normalized", "country_exact_match", "country_mismatch", "country_missing", "script_match", "query_is_s2", "missing_addr_q", "missing_addr_penalty", "us_state_mismatch")
    return x.select("query_id", "s1_id", *(cols[k].alias(k) for k in keep))


def _channels(ref: DataFrame, query: DataFrame) -> dict[str, DataFrame]:
    address = F.lower("business_address")
    exact = {k: blocking.exact(blocking.keyed(ref, c, "s1_id", 2), blocking.keyed(query, c, "query_id", 2), 30) for k, c in (("exact_name", F.lower("business_name")), ("exact_address", address))}
    return exact | {"bm25_name": retrieval.bm25_top(ref, query, "business_name", 15), "tfidf_name": retrieval.tfidf_top(ref, query, "business_name", 15)}


def main_features(spark: SparkSession, d: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Candidates of the channels and true pairs, as feature rows with labels. columns: the wanted features, all if it is None."""
    ref, query, edges = party_sides(spark, d)
    found = writers.kept(candidates.merged(_channels(ref, query)), "candidates")  # read twice by inject, which would search twice
    found = candidates.inject(found, edges).na.fill(0).fillna(999, [r for _, r in candidates.RANKED.values()] + ["best_retrieval_rank"])
    return features.main(found, features.prepared(query), features.prepared(ref), edges, columns)


def f7_main_features(spark: SparkSession, d: str) -> DataFrame:
    return main_features(spark, d)


def hybrid_candidates(ref: DataFrame, query: DataFrame, top_k: int = 15) -> DataFrame:
    name = text.normalize("business_name")
    r, q = ref.withColumn("n", name).withColumn("first", F.col("key")), query.withColumn("n", name)
    channels = {k: blocking.truncated(blocking.keyed(r, c, "s1_id", 1, "first"), blocking.keyed(q, c, "query_id")) for k, c in (("exact_name", F.col("n")), ("exact_address", text.normalize("business_address")), ("exact_combined", text.join_fields(F.col("n"), text.normalize("business_address"))))}
    channels["phonetic"] = blocking.truncated(blocking.phonetic_rows(r, "n", "s1_id", "first"), blocking.phonetic_rows(q, "n", "query_id"))
    channels["lsh"] = blocking.truncated(blocking.lsh_rows(r, "n", "s1_id", "first"), blocking.lsh_rows(q, "n", "query_id"))
    so_far = None
    for c in channels.values():
        so_far = c.select("query_id", "s1_id") if so_far is None else so_far.unionByName(c.select("query_id", "s1_id"))
    channels["token"] = blocking.sparse_token(blocking.token_rows(r, "n", "s1_id", 3, "first"), blocking.token_rows(q, "n", "query_id", 2), so_far)
    return candidates.merged_hybrid(channels, top_k)


def f8_hybrid_features(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = party_sides(spark, d)
    return features.hybrid(hybrid_candidates(ref, query), features.prepared(query), features.prepared(ref))


def f11_sieve_features(spark: SparkSession, d: str) -> DataFrame:
    ref, query, edges = party_sides(spark, d)
    c = party_pairs(ref, query, edges).withColumns({"score": F.lit(1.0), "rank": F.lit(1)})
    return features.sieve(c, query, ref)


def f11_sieve_native(spark: SparkSession, d: str) -> DataFrame:
    x = met(spark, d).select("query_id", "s1_id", text.clean("qn").alias("q_name"), text.clean("sn").alias("s_name"), text.clean("qa").alias("q_addr"), text.clean("sa").alias("s_addr"), F.col("qc").alias("q_country"), F.col("sc").alias("s_country"))
    cols = features.sieve_native()
    rounded = {k: F.round(c, 6) if k.endswith(("jaccard", "ratio")) else c for k, c in cols.items()}
    return x.select("query_id", "s1_id", *(c.alias(k) for k, c in rounded.items()))


QUERIES = {f.__name__: f for f in (p_veto, p5_vetoed_scores, n10_acronym, n11_distinct_names, f1_token_metrics, f2_similarity, f2_fuzzy, f4_f6_flags, f7_main_features, f8_hybrid_features, f11_sieve_features, f11_sieve_native)}

_P = f"WITH {sql.PAIRS}"
_ST = "CASE WHEN len(list_filter({0}n, lambda x: NOT list_contains({0}p, x))) > 0 THEN list_filter({0}n, lambda x: NOT list_contains({0}p, x)) ELSE {0}n END"
_VETO = f"""nums AS (SELECT *, {sql.numbers("qa")} AS qn1, {sql.numbers("sa")} AS sn1, {sql.pins("qa")} AS qp1, {sql.pins("sa")} AS sp1, {sql.state("qa", False)} AS qs, {sql.state("sa", False)} AS ss FROM met),
street AS (SELECT *, list_filter({_ST.format("q1_")}, lambda x: x <> '0') AS qx, list_filter({_ST.format("s1_")}, lambda x: x <> '0') AS sx FROM (SELECT *, qn1 AS q1_n, qp1 AS q1_p, sn1 AS s1_n, sp1 AS s1_p FROM nums)),
gates AS (SELECT query_id, s1_id, qn, sn, qa, sa, len(qx) > 0 AND len(sx) > 0 AND NOT list_has_any(qx, sx) AS numeric, len(qp1) > 0 AND len(sp1) > 0 AND NOT list_has_any(qp1, sp1) AS pin,
  (qc <> '' AND sc <> '' AND upper(qc) <> upper(sc)) OR ((upper(qc) = 'US' OR upper(sc) = 'US' OR qc = '') AND coalesce(qs <> ss, false)) AS geographic FROM street)"""
_W = "lower({0}n || ' ' || {0}a)"
_LEV = f"round(1 - levenshtein({_W.format('q')}, {_W.format('s')}) / greatest(length({_W.format('q')}), length({_W.format('s')})), 6)"
_TELL = f"list_filter({{}}, lambda w: NOT list_contains({sql.strings(tables.GENERIC)}, w) AND length(w) > 1)"
_DIST = "CASE WHEN len({0}) > 0 AND len({1}) > 0 AND NOT list_has_any({0}, {1}) THEN 1 ELSE 0 END"
_FLAG = "CASE WHEN {} THEN 1 ELSE 0 END"
ORACLE = {
    "p_veto": f"{_P}, {_VETO} SELECT query_id, s1_id, numeric, pin, geographic, numeric OR pin OR geographic AS veto FROM gates",
    "p5_vetoed_scores": f"{_P}, {_VETO} SELECT query_id, s1_id, CASE WHEN numeric OR pin OR geographic THEN 0.0 ELSE {_LEV} END AS score FROM gates",
    "n10_acronym": """WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT DISTINCT upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: substr(w, 1, 1)), '')) AS q FROM part)
        SELECT q, p_name, CASE WHEN length(q) BETWEEN 2 AND 6 AND starts_with(array_to_string(list_transform(string_split(upper(p_name), ' '), lambda w: substr(w, 1, 1)), ''), q) THEN 1 ELSE 0 END AS is_acronym
        FROM n JOIN q ON substr(upper(p_name), 1, 1) = substr(q, 1, 1)""",
    "n11_distinct_names": f"""{_P}, t AS (SELECT query_id, s1_id, {_TELL.format(sql.words(sql.norm("qn")))} AS a, {_TELL.format(sql.words(sql.norm("sn")))} AS b, {_TELL.format(sql.words(sql.norm("qa")))} AS c, {_TELL.format(sql.words(sql.norm("sa")))} AS d FROM met)
        SELECT query_id, s1_id, {_DIST.format("a", "b")} AS names, {_DIST.format("c", "d")} AS addresses FROM t""",
    "f1_token_metrics": f"""{_P}, t AS (SELECT query_id, s1_id, list_distinct({sql.words(_W.format("q"))}) AS a, list_distinct({sql.words(_W.format("s"))}) AS b FROM met)
        SELECT query_id, s1_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, len(list_intersect(a, b)) AS overlap, abs(len(a) - len(b)) AS diff FROM t""",
    "f2_similarity": f"""{_P} SELECT query_id, s1_id, {_LEV} AS lev, round(jaro_winkler_similarity({_W.format("q")}, {_W.format("s")}), 6) AS jw, abs(length({_W.format("q")}) - length({_W.format("s")})) AS len_diff,
        round(least(length({_W.format("q")}), length({_W.format("s")})) / greatest(length({_W.format("q")}), length({_W.format("s")})), 6) AS len_ratio FROM met""",
    "f4_f6_flags": f"""{_P} SELECT query_id, s1_id, {_FLAG.format("qn <> '' AND qn = sn")} AS exact_name_raw, {_FLAG.format("qa <> '' AND qa = sa")} AS exact_addr_raw, {_FLAG.format("qa <> '' AND lower(qa) = lower(sa)")} AS exact_addr_normalized,
        {_FLAG.format("qc <> '' AND sc <> '' AND qc = sc")} AS country_exact_match, {_FLAG.format("qc <> '' AND sc <> '' AND qc <> sc")} AS country_mismatch, {_FLAG.format("qc = '' OR sc = ''")} AS country_missing, 1 AS script_match,
        {_FLAG.format("starts_with(query_id, 'S2-')")} AS query_is_s2, {_FLAG.format("qa = ''")} AS missing_addr_q, {_FLAG.format("(qa = '') <> (sa = '')")} AS missing_addr_penalty, 0 AS us_state_mismatch FROM met""",
    "f11_sieve_native": f"""{_P}, c AS (SELECT query_id, s1_id, {sql.clean("qn")} AS qn, {sql.clean("sn")} AS sn, {sql.clean("qa")} AS qa, {sql.clean("sa")} AS sa, upper(qc) AS qc, upper(sc) AS sc FROM met),
        x AS (SELECT *, {sql.numbers("qa")} AS a, {sql.numbers("sa")} AS b, {sql.pins("qa")} AS u, {sql.pins("sa")} AS v, {sql.state("qa", False)} AS s, {sql.state("sa", False)} AS t FROM c)
        SELECT query_id, s1_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, 6) AS num_jaccard,
          CASE WHEN len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS num_conflict, CASE WHEN len(u) > 0 AND len(v) > 0 THEN CASE WHEN list_has_any(u, v) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE 0.0::DOUBLE END AS pin_match,
          CASE WHEN qc <> '' AND sc <> '' AND qc = sc THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS country_match, CASE WHEN qc <> '' AND sc <> '' AND qc <> sc THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS country_mismatch,
          CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN CASE WHEN s = t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.5::DOUBLE END AS state_match, CASE WHEN coalesce(s <> t, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS state_mismatch,
          CASE WHEN split_part(qn, ' ', 1) = split_part(sn, ' ', 1) AND qn <> '' AND sn <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS first_word_match,
          abs(length(qn) - length(sn)) AS name_len_diff, round(least(length(qn), length(sn)) / greatest(length(qn), length(sn), 1), 6) AS name_len_ratio,
          abs(length(qa) - length(sa)) AS addr_len_diff, round(least(length(qa), length(sa)) / greatest(length(qa), length(sa), 1), 6) AS addr_len_ratio FROM x""",
}
