"""Queries of scans, views and string scalars, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonetics, text
from ..sources import readers
from . import sql


def sc1_records(spark: SparkSession, d: str) -> DataFrame:
    r = readers.records(spark, d)
    return r.select("entity_id", *(text.strip(c).alias(c) for c in readers.RECORD[1:]))


_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reference and query records of documents, and edges of equal texts."""
    r = readers.records(spark, d)
    ref, query = readers.reference_side(r), readers.query_side(r)
    same = ["business_name", "business_address", "country"]
    edges = query.select(F.col("entity_id").alias("query_id"), *same).join(ref.select(F.col("entity_id").alias("s1_id"), *same), same).select("s1_id", "query_id")
    return ref, query, edges


def sc2_truth_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as lists, and the lists read again."""
    _, _, edges = sides(spark, d)
    lists = edges.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.array_join(F.array_sort(F.collect_list("query_id")), " , ").alias("matched_entity_ids"))
    return readers.truth_edges(lists)


def n1_normalize(spark: SparkSession, d: str) -> DataFrame:
    r = readers.records(spark, d)
    return r.select("entity_id", text.normalize("business_name").alias("name_normalized"), text.normalize("business_address").alias("address_normalized"))


def n2_transliterate(spark: SparkSession, d: str) -> DataFrame:
    """The full forms: plain rows in the JVM, others through Arrow."""
    x = text.with_forms(readers.records(spark, d), {"name": "business_name", "address": "business_address"})
    return x.select("entity_id", "name_normalized", "name_transliterated", "address_transliterated", text.join_fields(F.col("name_transliterated"), F.col("address_transliterated")).alias("combined_transliterated"))


def n4_clean(spark: SparkSession, d: str) -> DataFrame:
    r = readers.records(spark, d)
    return r.select("entity_id", text.clean("business_name").alias("name_norm"), text.clean("business_address").alias("addr_norm"), text.country("country").alias("country_clean"))


def n6_script(spark: SparkSession, d: str) -> DataFrame:
    return readers.records(spark, d).select("entity_id", text.script("business_name").alias("name_script"), text.script("business_address").alias("address_script"))


def n7_serialize(spark: SparkSession, d: str) -> DataFrame:
    f = (text.clean("business_name"), text.clean("business_address"), text.country("country"))
    return readers.records(spark, d).select("entity_id", text.serialize(*f).alias("compact"), text.serialize(*f, "ditto").alias("ditto"))


def n8_state(spark: SparkSession, d: str) -> DataFrame:
    """The last state code of an address, with and without the federal district."""
    return readers.records(spark, d).select("entity_id", text.state("business_address").alias("state"), text.state(F.lower("business_address"), False).alias("state_50"))


def n9_numbers(spark: SparkSession, d: str) -> DataFrame:
    cols = {"numbers": text.numbers, "pins": text.pins, "street_numbers": text.street_numbers}
    return readers.records(spark, d).select("entity_id", *(F.array_join(F.array_sort(f("business_address")), ",").alias(k) for k, f in cols.items()))


def words_of(spark: SparkSession, d: str) -> DataFrame:
    return readers.records(spark, d).select(F.explode(text.words(F.col("business_name"))).alias("word")).where(F.length("word") >= 2).distinct()


def n12_soundex(spark: SparkSession, d: str) -> DataFrame:
    return words_of(spark, d).select("word", phonetics.soundex(F.col("word")).alias("soundex"))


def n13_metaphone(spark: SparkSession, d: str) -> DataFrame:
    return phonetics.token_codes(readers.records(spark, d), "business_name")


def n14_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return words_of(spark, d).select("word", phonetics.skeleton(F.col("word")).alias("skeleton"))


def n15_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return readers.records(spark, d).select("entity_id", phonetics.fingerprint_udf("business_name").alias("fingerprint"))


def n16_phonetic_keys(spark: SparkSession, d: str) -> DataFrame:
    return phonetics.with_keys(readers.records(spark, d).select("entity_id", "business_name"), "business_name").select("entity_id", "key")


def n17_gram_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = text.gram_ids(text.normalize("business_name"))
    return readers.records(spark, d).select("entity_id", F.size(ids).cast("long").alias("n"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def n18_padded_grams(spark: SparkSession, d: str) -> DataFrame:
    return readers.records(spark, d).select("entity_id", F.array_join(text.padded_gram_ids(text.normalize("business_name")), ",").alias("ids"))


def sc1_file(spark: SparkSession, d: str) -> DataFrame:
    """Records written to a tab-separated file, with the word NA, quotes and white space, and scanned from it."""
    flat = lambda c: F.regexp_replace(text.text(c), r"[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]", " ")
    rows = readers.records(spark, d).select("entity_id", F.concat(F.lit(' "'), flat("business_name"), F.lit(" ")).alias("business_name"), F.lit("NA").alias("business_address"), "country")
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="kindred-tsv-")
    at = f"{root.rstrip('/')}/records-{uuid.uuid4().hex}"
    lines = rows.select(F.concat_ws("\t", *readers.RECORD).alias("value"))
    header = spark.createDataFrame([("\t".join(readers.RECORD),)], "value string")
    lines.unionByName(header).orderBy(F.col("value") != "\t".join(readers.RECORD)).coalesce(1).write.text(at)
    return readers.record_file(spark, at)


def sc4_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Queries of every third record of one source, found by id with that source scanned alone."""
    records = readers.records(spark, d).select(*readers.RECORD, "doc_id")
    wanted = records.where("entity_id like 'S2-%' and doc_id % 9 = 1").select("entity_id")
    return readers.by_source(records, wanted).select("entity_id", "business_name")


def sc6_capped(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred queries."""
    return readers.capped(readers.query_side(readers.records(spark, d)).select("entity_id", "business_name"), 100)


def t6_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each name."""
    from ..operators import sampling

    return sampling.first_rows(readers.records(spark, d), "business_name", "doc_id").select("business_name", "entity_id")


QUERIES = {f.__name__: f for f in (sc1_records, sc1_file, sc4_by_source, sc6_capped, sc2_truth_edges, n1_normalize, n2_transliterate, n4_clean, n6_script, n7_serialize, n8_state, n9_numbers, n12_soundex, n13_metaphone, n14_skeleton, n15_fingerprint, n16_phonetic_keys, n17_gram_ids, n18_padded_grams, t6_first_rows)}

_R = f"WITH {sql.RECORDS} "
_N, _A = "business_name", "business_address"
_LEX = rf"array_to_string(list_sort({{}}), ',')"
_HASH = "(('0x' || substr(md5({}), 1, 8))::BIGINT & 2147483647)"
_GRAMS = "CASE WHEN length({0}) < 3 THEN list_filter([{0}], lambda w: w <> '') ELSE list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)) END"
ORACLE = {
    "sc1_records": _R + f"SELECT entity_id, {_STRIP.format(_N)} AS business_name, {_STRIP.format(_A)} AS business_address, {_STRIP.format('country')} AS country FROM records",
    "sc2_truth_edges": f"WITH {sql.SIDES} SELECT s1_id, query_id FROM truth",
    "sc1_file": _R + rf"""SELECT entity_id, regexp_replace('"' || regexp_replace(business_name, '[\x00-\x1F\x7F\x{{85}}\x{{2028}}\x{{2029}}]', ' ', 'g') || ' ', '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS business_name, 'NA' AS business_address, country FROM records""",
    "sc4_by_source": _R + "SELECT entity_id, business_name FROM records WHERE doc_id % 9 = 1",
    "sc6_capped": _R + "SELECT entity_id, business_name FROM records WHERE entity_id NOT LIKE 'S1-%' ORDER BY entity_id LIMIT 100",
    "n12_soundex": _R + f"SELECT word, {sql.soundex('word')} AS soundex FROM (SELECT DISTINCT unnest({sql.words('business_name')}) AS word FROM records) WHERE length(word) >= 2",
    "n1_normalize": _R + f"SELECT entity_id, {sql.norm(_N)} AS name_normalized, {sql.norm(_A)} AS address_normalized FROM records",
    "n2_transliterate": _R + f"SELECT entity_id, {sql.norm(_N)} AS name_normalized, {sql.latin(_N)} AS name_transliterated, {sql.latin(_A)} AS address_transliterated, trim({sql.latin(_N)} || ' ' || {sql.latin(_A)}) AS combined_transliterated FROM records",
    "n4_clean": _R + f"SELECT entity_id, {sql.clean(_N)} AS name_norm, {sql.clean(_A)} AS addr_norm, upper(country) AS country_clean FROM records",
    "n6_script": _R + f"SELECT entity_id, {sql.script(_N)} AS name_script, {sql.script(_A)} AS address_script FROM records",
    "n7_serialize": _R + f"""SELECT entity_id, CASE WHEN n = '' AND a = '' AND c = '' THEN '[NAME] unknown' ELSE concat_ws(' ', CASE WHEN n <> '' THEN '[NAME] ' || n END, CASE WHEN a <> '' THEN '[ADDR] ' || a END, CASE WHEN c <> '' THEN '[CTRY] ' || c END) END AS compact,
        concat_ws(' ', CASE WHEN n <> '' THEN '[COL] name [VAL] ' || n END, CASE WHEN a <> '' THEN '[COL] address [VAL] ' || a END, CASE WHEN c <> '' THEN '[COL] country [VAL] ' || c END) AS ditto
        FROM (SELECT entity_id, {sql.clean(_N)} AS n, {sql.clean(_A)} AS a, upper(country) AS c FROM records)""",
    "n8_state": _R + f"SELECT entity_id, {sql.state(_A)} AS state, {sql.state(_A, False)} AS state_50 FROM records",
    "n9_numbers": _R + f"""SELECT entity_id, {_LEX.format("n")} AS numbers, {_LEX.format("p")} AS pins, {_LEX.format("CASE WHEN len(list_filter(n, lambda x: NOT list_contains(p, x))) > 0 THEN list_filter(n, lambda x: NOT list_contains(p, x)) ELSE n END")} AS street_numbers
        FROM (SELECT entity_id, {sql.numbers(_A)} AS n, {sql.pins(_A)} AS p FROM records)""",
    "n14_skeleton": _R + f"""SELECT word, substr(substr(x, 1, 1) || regexp_replace(substr(x, 2), '[AEIOUYHW]', '', 'g'), 1, 5) AS skeleton FROM (SELECT DISTINCT word, regexp_replace(upper(replace(word, 'ß', 'ss')), '[^A-Z]', '', 'g') AS x
        FROM (SELECT unnest({sql.words(_N)}) AS word FROM records) WHERE length(word) >= 2)""",
    "n17_gram_ids": _R + f"SELECT entity_id, len(g)::BIGINT AS n, coalesce(list_sum(list_transform(g, lambda x: {_HASH.format('x')})), 0)::BIGINT AS total FROM (SELECT entity_id, {_GRAMS.format('t')} AS g FROM (SELECT entity_id, {sql.norm(_N)} AS t FROM records))",
    "n18_padded_grams": _R + f"SELECT entity_id, array_to_string((list_concat(list_transform(g, lambda x: {_HASH.format('x')} % 65535 + 1), list_transform(range(32), lambda i: 0)))[1:32], ',') AS ids FROM (SELECT entity_id, {_GRAMS.format('t')} AS g FROM (SELECT entity_id, '<' || {sql.norm(_N)} || '>' AS t FROM records))",
    "t6_first_rows": _R + "SELECT business_name, min_by(entity_id, doc_id) AS entity_id FROM records GROUP BY business_name",
}
