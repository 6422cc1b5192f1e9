"""Feature rows of candidate pairs: three extractors, each one select over pairs joined to both records.

Per-record work (normalising, scripts, states) is done on records before the join. Missing records give empty fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonetics, similarity, text
from . import veto

_FIELDS = ("business_name", "business_address", "country", "name_normalized", "address_normalized", "name_transliterated", "address_transliterated")


def prepared(records: DataFrame) -> DataFrame:
    """Records with normalised and transliterated forms, combined ones too, script and state."""
    x = text.with_forms(records, {"name": "business_name", "address": "business_address"})
    return x.withColumns({
        "combined_normalized": text.join_fields(F.col("name_normalized"), F.col("address_normalized")),
        "combined_transliterated": text.join_fields(F.col("name_transliterated"), F.col("address_transliterated")),
        "script": text.script("business_name"),
        "state": F.when(text.country("country") == "US", text.state("business_address")),
    })


def facts(pairs: DataFrame, query: DataFrame, reference: DataFrame) -> DataFrame:
    """pairs with the fields of both records as q_... and s_...; a record that is missing gives empty strings."""

    def side(df: DataFrame, id_as: str, prefix: str) -> DataFrame:
        return df.select(F.col("entity_id").alias(id_as), *(F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in ("entity_id", "doc_id", "key")))

    x = pairs.join(side(query, "query_id", "q"), "query_id", "left").join(side(reference, "s1_id", "s"), "s1_id", "left")
    return x.na.fill("", [c for c, t in x.dtypes if t == "string" and c[:2] in ("q_", "s_") and not c.endswith("_state")])


def _flag(x: Column) -> Column:
    return F.when(x, 1).otherwise(0)


def _same(c: str) -> Column:
    return _flag((F.col(f"q_{c}") != "") & (F.col(f"q_{c}") == F.col(f"s_{c}")))


def _pair(c: str) -> tuple[Column, Column]:
    return F.col(f"q_{c}"), F.col(f"s_{c}")


def countries(prefix: str = "country") -> dict[str, Column]:
    q, s = (F.lower(text.strip(c)) for c in ("q_country", "s_country"))
    known = (q != "") & (s != "")
    return {f"{prefix}_exact_match": _flag(known & (q == s)), f"{prefix}_mismatch": _flag(known & (q != s)), f"{prefix}_missing": _flag(~known)}


def with_fuzzy(x: DataFrame, **pairs: tuple[str, ...]) -> DataFrame:
    """Struct columns f_<name> of UDF similarities of q_<column>, s_<column>; pairs: the column, then which are wanted (all five if none is named)."""
    return x.withColumns({f"f_{k}": similarity.fuzzy(*_pair(c), *wanted) for k, (c, *wanted) in pairs.items()})


RETRIEVAL = (
    "by_exact_name by_exact_address by_exact_combined by_bm25_name bm25_name_score bm25_name_rank by_bm25_combined bm25_comb_score bm25_comb_rank "
    "by_tfidf_name tfidf_name_score tfidf_name_rank by_tfidf_address tfidf_addr_score tfidf_addr_rank "
    "retrieval_agreement_count best_retrieval_rank best_reciprocal_rank"
).split()
_UDF = (("jaro_winkler", "jaro_winkler"), ("fuzz_ratio", "fuzz_ratio"), ("partial_ratio", "partial_ratio"), ("token_sort", "token_sort"), ("token_set", "token_set"))


def native_main() -> dict[str, Column]:
    """The main extractor's columns that need no UDF and no retrieval."""
    out = {"exact_name_raw": _same("business_name"), "exact_name_normalized": _same("name_normalized"), "exact_addr_raw": _same("business_address"), "exact_addr_normalized": _same("address_normalized"), "exact_combined_normalized": _same("combined_normalized")}
    for p, c in (("name", "name"), ("addr", "address")):
        q, s = _pair(f"{c}_normalized")
        out |= {
            f"{p}_levenshtein": similarity.levenshtein(q, s), f"{p}_char_len_diff": similarity.length_diff(q, s), f"{p}_char_len_ratio": similarity.length_ratio(q, s),
            f"{p}_token_overlap": similarity.token_overlap(q, s), f"{p}_token_count_diff": similarity.token_diff(q, s), f"{p}_translit_lev": similarity.levenshtein(*_pair(f"{c}_transliterated")),
        }
    q, s = _pair("business_address")
    known = (F.col("q_script") != "Empty") & (F.col("s_script") != "Empty")
    return out | countries() | {
        "script_match": _flag(known & (F.col("q_script") == F.col("s_script"))), "script_mismatch": _flag(known & (F.col("q_script") != F.col("s_script"))),
        "query_is_s2": _flag(F.col("query_id").startswith("S2-")),
        "missing_name_q": _flag(F.col("q_business_name") == ""), "missing_addr_q": _flag(q == ""), "missing_name_s1": _flag(F.col("s_business_name") == ""), "missing_addr_s1": _flag(s == ""),
        "is_acronym_match": text.acronym(*_pair("business_name")), "distinct_name_mismatch": text.distinct_names(*_pair("name_normalized")),
        "us_state_mismatch": _flag(F.coalesce(F.col("q_state") != F.col("s_state"), F.lit(False))), "missing_addr_penalty": _flag((q == "") != (s == "")),
    }


def ablation_stages() -> dict[str, list[str]]:
    """Ten growing sets of the main extractor's columns."""
    similar = lambda p: [f"{p}_{x}" for x in ("levenshtein", "char_len_diff", "char_len_ratio", "token_overlap", "token_count_diff", "translit_lev", *(new for new, _ in _UDF))]
    exact, name, addr = [c for c in native_main() if c.startswith("exact_")], similar("name"), similar("addr")
    out = {"exact": exact, "name": name, "address": addr, "name_address": name + addr}
    grown = out["name_address"]
    for stage, more in (
        ("country", list(countries())),
        ("script", ["script_match", "script_mismatch"]),
        ("agreement", list(RETRIEVAL[-3:])),
        ("bm25", [c for c in RETRIEVAL if "bm25" in c]),
        ("tfidf", [c for c in RETRIEVAL if "tfidf" in c]),
    ):
        out[stage] = grown = grown + more
    rest = ["combined_token_set", "weighted_composite_similarity", *(c for c in (*RETRIEVAL, *native_main()) if c not in grown)]
    return out | {"full": grown + rest}


def main(candidates: DataFrame, query: DataFrame, reference: DataFrame, truth: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """query_id, s1_id and the 61 columns of the main variant; is_match too if truth (s1_id, query_id) is given.

    columns: the wanted ones, all if it is None. Spark leaves out what nobody reads, but not a UDF's single similarities.
    """
    cols = {c: F.col(c) for c in RETRIEVAL} | native_main()
    cols |= {f"{p}_{new}": F.col(f"f_{p}.{c}") for p in ("name", "addr") for new, c in _UDF}
    cols["combined_token_set"] = F.col("f_combined.token_set")
    cols["weighted_composite_similarity"] = 0.55 * F.col("f_name.jaro_winkler") + 0.35 * F.col("f_addr.jaro_winkler") + 0.10 * F.col("f_combined.token_set")
    cols = {k: c for k, c in cols.items() if columns is None or k in columns}
    whole = "weighted_composite_similarity" in cols
    used = {p: [c for new, c in _UDF if f"{p}_{new}" in cols or (whole and c == "jaro_winkler")] for p in ("name", "addr")}
    used["combined"] = ["token_set"] if whole or "combined_token_set" in cols else []
    fields = {"name": "name_normalized", "addr": "address_normalized", "combined": "combined_normalized"}
    x = with_fuzzy(facts(candidates, query, reference), **{p: (fields[p], *some) for p, some in used.items() if some})
    out = x.select("query_id", "s1_id", *(c.alias(k) for k, c in cols.items()))
    return out if truth is None else labelled(out, truth)


def labelled(features: DataFrame, truth: DataFrame) -> DataFrame:
    t = truth.select("s1_id", "query_id", F.lit(1).alias("is_match")).distinct()
    return features.join(t, ["s1_id", "query_id"], "left").withColumn("is_match", F.coalesce("is_match", F.lit(0)))


HYBRID_FLAGS = ("by_exact_name", "by_exact_address", "by_exact_combined", "by_phonetic", "by_lsh", "by_token", "channel_agreement")


def hybrid(candidates: DataFrame, query: DataFrame, reference: DataFrame) -> DataFrame:
    """query_id, s1_id and the 30 columns of the hybrid variant, on transliterated text; dense scores are token Jaccard."""
    x = with_fuzzy(facts(candidates, query, reference), name=("name_transliterated", "jaro_winkler", "token_sort", "token_set"), addr=("address_transliterated", "jaro_winkler", "token_sort"))
    x = x.withColumns({f"{p}_codes": phonetics.metaphones_udf(f"{p}_name_transliterated") for p in "qs"})
    first = {p: F.coalesce(F.try_element_at(text.words(F.col(f"{p}_name_transliterated")), F.lit(1)), F.lit("")) for p in "qs"}
    x = x.withColumns({f"{p}_first": first[p] for p in "qs"}).withColumns({f"{p}_m": phonetics.metaphone_udf(f"{p}_first") for p in "qs"})
    some = (F.col("q_first") != "") & (F.col("s_first") != "")
    (qn, sn), (qa, sa), (qc, sc) = (_pair(f"{c}_transliterated") for c in ("name", "address", "combined"))
    jac = similarity.token_jaccard
    cols = {
        "exact_name_raw": _same("business_name"), "exact_name_normalized": _same("name_transliterated"), "exact_addr_normalized": _same("address_transliterated"), "exact_comb_normalized": _same("combined_transliterated"),
        "name_levenshtein": similarity.levenshtein(qn, sn), "name_jaro_winkler": F.col("f_name.jaro_winkler"), "name_token_sort": F.col("f_name.token_sort"), "name_token_set": F.col("f_name.token_set"),
        "name_token_overlap": jac(qn, sn), "name_char_len_ratio": similarity.length_ratio(qn, sn, 1.0),
        "addr_levenshtein": similarity.levenshtein(qa, sa), "addr_jaro_winkler": F.col("f_addr.jaro_winkler"), "addr_token_sort": F.col("f_addr.token_sort"), "addr_token_overlap": jac(qa, sa), "addr_char_len_ratio": similarity.length_ratio(qa, sa, 1.0),
        "soundex_match": _flag(some & (phonetics.soundex(F.col("q_first")) == phonetics.soundex(F.col("s_first")))), "metaphone_match": _flag(some & (F.col("q_m") == F.col("s_m"))), "phonetic_token_jaccard": phonetics.jaccard(F.col("q_codes"), F.col("s_codes")),
        "dense_semantic_name": jac(qn, sn), "dense_semantic_comb": jac(qc, sc),
    }
    return x.select("query_id", "s1_id", *(c.alias(k) for k, c in cols.items()), *HYBRID_FLAGS, *(c.alias(k) for k, c in countries().items()))


def sieve_native() -> dict[str, Column]:
    """The sieve extractor's columns on numbers, places and lengths; over q_name, s_name, q_addr, s_addr, q_country, s_country."""
    (qn, sn), (qa, sa) = _pair("name"), _pair("addr")
    x, y = text.numbers(qa), text.numbers(sa)
    both = (F.size(x) > 0) & (F.size(y) > 0)
    shared = F.size(F.array_intersect(x, y))
    u, v = text.pins(qa), text.pins(sa)
    s, t = text.state(qa, district=False), text.state(sa, district=False)
    qc, sc = text.country("q_country"), text.country("s_country")
    known = (qc != "") & (sc != "")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    w = lambda c: F.try_element_at(text.words(c), F.lit(1))
    return {
        "num_jaccard": F.when(both, shared / F.size(F.array_union(x, y))).when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(0.5), "num_conflict": one(both & (shared == 0)),
        "pin_match": F.when((F.size(u) > 0) & (F.size(v) > 0), F.when(F.arrays_overlap(u, v), 1.0).otherwise(-1.0)).otherwise(0.0),
        "country_match": one(known & (qc == sc)), "country_mismatch": one(known & (qc != sc)),
        "state_match": F.when(s.isNotNull() & t.isNotNull(), one(s == t)).otherwise(0.5), "state_mismatch": one(F.coalesce(s != t, F.lit(False))),
        "first_word_match": one(F.coalesce(w(qn) == w(sn), F.lit(False))),
        "name_len_diff": similarity.length_diff(qn, sn), "name_len_ratio": similarity.length_ratio(qn, sn), "addr_len_diff": similarity.length_diff(qa, sa), "addr_len_ratio": similarity.length_ratio(qa, sa),
    }


def sieve(candidates: DataFrame, query: DataFrame, reference: DataFrame) -> DataFrame:
    """query_id, s1_id, the 28 columns of the sieve variant and veto. candidates have score and rank; records clean fields."""

    def side(df: DataFrame, id_as: str, p: str) -> DataFrame:
        cleaned = text.with_clean(df, {f"{p}_name": "business_name", f"{p}_addr": "business_address"})
        return cleaned.select(F.col("entity_id").alias(id_as), f"{p}_name", f"{p}_addr", F.col("country").alias(f"{p}_country"))

    x = candidates.join(side(query, "query_id", "q"), "query_id", "left").join(side(reference, "s1_id", "s"), "s1_id", "left").na.fill("", ["q_name", "q_addr", "q_country", "s_name", "s_addr", "s_country"])
    for p in "qs":
        x = x.withColumn(f"{p}_prefix", F.array_join(F.slice(text.words(F.col(f"{p}_name")), 1, 2), " ")).withColumn(f"{p}_comb", F.concat_ws(" ", f"{p}_name", f"{p}_addr"))
    x = with_fuzzy(x, name=("name",), addr=("addr",), prefix=("prefix", "jaro_winkler"), comb=("comb", "token_sort", "token_set"))
    names = (("jw", "jaro_winkler"), ("sort", "token_sort"), ("set", "token_set"), ("ratio", "fuzz_ratio"), ("partial", "partial_ratio"))
    fuzz = {f"{p}_{new}": F.col(f"f_{p}.{c}") for p in ("name", "addr") for new, c in names} | {"comb_sort": F.col("f_comb.token_sort"), "comb_set": F.col("f_comb.token_set"), "brand_prefix_jw": F.col("f_prefix.jaro_winkler")}
    rank = {"bm25_score": F.col("score").cast("double"), "retrieval_rank": F.col("rank").cast("double"), "is_top1": F.when(F.col("rank") == 1, 1.0).otherwise(0.0)}
    gate = veto.veto(F.col("q_addr"), F.col("s_addr"), F.col("q_country"), F.col("s_country"))
    return x.select("query_id", "s1_id", *(c.alias(k) for k, c in (sieve_native() | fuzz | rank).items()), gate.alias("veto"))
