"""Queries of decisions, metrics, profiles, samples, sinks, checks, models and whole pipelines, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assign, blocking, candidates, features, metrics, models, profile, retrieval, sampling, validate
from ..sources import readers, writers
from ..streaming import replay
from . import pipelines, sql
from .link_queries import _bm25_sql, _tfidf_sql
from .pair_queries import hybrid_candidates, main_features, party_pairs, party_sides, scored
from .text_queries import sides

ABS, MARGIN = 0.55, 0.005
ABSOLUTES, MARGINS = (0.50, 0.53, 0.55, 0.57, 0.59, 0.65), (0.0, 0.005, 0.01, 0.02)


def d_v1_main(spark: SparkSession, d: str) -> DataFrame:
    return assign.main(scored(spark, d), ABS, MARGIN)


def d_v1_all(spark: SparkSession, d: str) -> DataFrame:
    return assign.main(scored(spark, d), ABS, MARGIN, exclusive=False)


def d_v2_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return assign.hybrid(scored(spark, d), ABS, MARGIN)


def d_v3_sieve(spark: SparkSession, d: str) -> DataFrame:
    """Queries of the least key of each nation are locked to their true record."""
    ref, query, edges = party_sides(spark, d)
    first = query.groupBy("business_address").agg(F.min_by("entity_id", "key").alias("query_id"))
    return assign.sieve(edges.join(first, "query_id").select("query_id", "s1_id"), scored(spark, d), ABS, MARGIN)


def d_v4_late(spark: SparkSession, d: str) -> DataFrame:
    return assign.late(scored(spark, d), ABS, 0.0)


def w2_runner_up(spark: SparkSession, d: str) -> DataFrame:
    return assign.best_two(scored(spark, d))


def decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reference records, truth and predictions over parties."""
    ref, _, edges = party_sides(spark, d)
    return ref, edges, d_v1_main(spark, d).select("s1_id", "query_id")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    ref, edges, predicted = decided(spark, d)
    return metrics.counts(ref.select(F.col("entity_id").alias("s1_id")), edges, predicted)


def a5_entity_f(spark: SparkSession, d: str) -> DataFrame:
    return metrics.scored(_counts(spark, d)).select("s1_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f")))


def a6_macro_f(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro(_counts(spark, d))


def a6_macro_f_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro(_counts(spark, d), digits=5, singletons_recalled=True)


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ref, query, edges = party_sides(spark, d)
    exact = blocking.exact(blocking.keyed(ref, F.col("business_address"), "s1_id", 2), blocking.keyed(query, F.col("business_address"), "query_id", 2), 30)
    return query, edges, candidates.merged({"exact_address": exact, "bm25_name": retrieval.bm25_top(ref, query, "business_name", 3), "tfidf_name": retrieval.tfidf_top(ref, query, "business_name", 20)})


def a7_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    _, edges, found = _found(spark, d)
    return metrics.recall_at(edges, found)


def a8_recall_slices(spark: SparkSession, d: str) -> DataFrame:
    ref, query, edges = party_sides(spark, d)
    return metrics.recall_slices(edges, d_v1_main(spark, d), query, text.script("business_name"))


def a9_errors(spark: SparkSession, d: str) -> DataFrame:
    ref, query, edges = party_sides(spark, d)
    return metrics.errors(edges, d_v1_main(spark, d), scored(spark, d).where("score >= 0.555"))


def a10_singletons(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cardinality_accuracy(_counts(spark, d))


def a11_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cardinality(_counts(spark, d))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    ref, _, edges = party_sides(spark, d)
    return metrics.grid(ref.select(F.col("entity_id").alias("s1_id")), edges, assign.best_two(scored(spark, d)), ABSOLUTES, MARGINS)


def a13_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


def a13_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.grid_best(_grid(spark, d))


def a14_log_loss(spark: SparkSession, d: str) -> DataFrame:
    _, _, edges = party_sides(spark, d)
    x = scored(spark, d).join(edges.withColumn("label", F.lit(1)), ["s1_id", "query_id"], "left").select(F.coalesce("label", F.lit(0)).alias("label"), F.col("score").alias("p"))
    return metrics.log_loss(x)


def m8_ranking_loss(spark: SparkSession, d: str) -> DataFrame:
    """Loss of each query's true pair against its best other one."""
    _, _, edges = party_sides(spark, d)
    x = scored(spark, d).join(edges.withColumn("t", F.lit(1)), ["s1_id", "query_id"], "left")
    by = x.groupBy("query_id").agg(F.max(F.when(F.col("t") == 1, F.col("score"))).alias("p"), F.max(F.when(F.col("t").isNull(), F.col("score"))).alias("n")).where("p is not null and n is not null")
    return by.select("query_id", F.round(sampling.ranking_loss(F.col("p"), F.col("n")), 6).alias("loss"))


def a3_source_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.source(readers.records(spark, d))


def a4_truth_profile(spark: SparkSession, d: str) -> DataFrame:
    ref, _, edges = sides(spark, d)
    return profile.truth(ref, edges)


def sc3_coherent_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 200 reference records, 50 of their queries and 30 unmatched ones, which is what the operator is for."""
    ref, query, edges = party_sides(spark, d)
    got = sampling.coherent(ref, query, edges, 200, 50, 30)
    return got["reference"].select(F.lit("reference").alias("part"), "entity_id").unionByName(got["query"].select(F.lit("query").alias("part"), "entity_id"))


def m1_split(spark: SparkSession, d: str) -> DataFrame:
    ref, query, edges = party_sides(spark, d)
    out = None
    for name, df in sampling.split(ref, query, edges).items():
        one = df.select(F.lit(name).alias("part"), F.concat_ws("+", "s1_id", "query_id").alias("id") if name.endswith("edges") else F.col("entity_id").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


def _labelled_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs with labels and a category by score."""
    _, _, edges = party_sides(spark, d)
    x = scored(spark, d).join(edges.withColumn("t", F.lit(1)), ["s1_id", "query_id"], "left").withColumn("is_match", F.coalesce("t", F.lit(0))).drop("t")
    return x.withColumn("category", F.when(F.col("score") >= 0.575, "hard_lexical").when(F.col("score") >= 0.555, "hard_address").when(F.col("score") >= 0.53, "same_country").otherwise("random"))


def m2_categories(spark: SparkSession, d: str) -> DataFrame:
    f = main_features(spark, d, sampling.CATEGORY_COLUMNS)
    return f.groupBy(sampling.category().alias("category"), "is_match").agg(F.count("*").alias("n"))


def m3_negatives(spark: SparkSession, d: str) -> DataFrame:
    return sampling.negatives(_labelled_scores(spark, d), ratio=2).select("query_id", "s1_id", "is_match")


def m7_triplets(spark: SparkSession, d: str) -> DataFrame:
    ref, query, edges = party_sides(spark, d)
    return sampling.triplets(party_pairs(ref, query, edges), edges)


def sk1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    ref, _, predicted = decided(spark, d)
    return writers.collapsed(ref, predicted)


def sk4_subset(spark: SparkSession, d: str) -> DataFrame:
    """Predictions within candidates, and candidates with predictions added."""
    _, _, predicted = decided(spark, d)
    found = scored(spark, d).where("score >= 0.56")
    kept, _ = writers.subset_candidates(predicted, found)
    _, extended = writers.subset_candidates(predicted, found, "extend")
    return kept.select(F.lit("kept").alias("part"), "s1_id", "query_id").unionByName(extended.select(F.lit("extended").alias("part"), "s1_id", "query_id"))


def m11_violations(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a result table with planted faults: a row gone, a row twice, a repeated id, a self match, a wrong prefix."""
    ref, _, predicted = decided(spark, d)
    rows = writers.collapsed(ref, predicted).select(F.col("source1_entity_id").alias("s1_id"), F.col("matched_entity_ids").alias("ids"))
    key = F.regexp_extract("s1_id", r"\d+$", 0).cast("long")
    bad = rows.where(key % 97 != 5).withColumn("ids", F.when(key % 97 == 1, "S2-4,S2-4").when(key % 97 == 2, F.col("s1_id")).when(key % 97 == 3, "X-1").otherwise(F.col("ids")))
    return validate.lists(bad.unionByName(rows.where(key % 97 == 7)), ref, "matching").unionByName(validate.subset(bad, rows))


def pipeline_main(spark: SparkSession, d: str) -> DataFrame:
    """The main variant end to end over parties, scored by the composite similarity and agreement."""
    ref, query, _ = party_sides(spark, d)
    edges, _ = pipelines.main(ref, query, 0.6 * F.col("weighted_composite_similarity") + 0.4 * F.col("name_token_overlap") / 2, 0.4, 0.01, pipelines.Limits(15, 5, 3, 5, 0))
    return writers.collapsed(ref, edges.select("s1_id", "query_id"))


def pipeline_sieve(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = party_sides(spark, d)
    edges, _ = pipelines.sieve(ref, query, 0.7 * F.col("name_sort") + 0.3 * F.col("comb_set"))
    return writers.collapsed(ref, edges.select("s1_id", "query_id"))


def pipeline_hybrid(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = party_sides(spark, d)
    edges, _ = pipelines.hybrid(ref, query, hybrid_candidates(ref, query), 0.5 * F.col("name_levenshtein") + 0.5 * F.col("name_token_overlap"), 0.3, 0.01)
    return writers.collapsed(ref, edges.select("s1_id", "query_id"))


def pipeline_late(spark: SparkSession, d: str) -> DataFrame:
    ref, query, _ = party_sides(spark, d)
    edges, _ = pipelines.late(ref, query, 0.4, 0.0)
    return writers.collapsed(ref, edges.select("s1_id", "query_id"))


_COLUMNS = ("name_levenshtein", "name_jaro_winkler", "name_token_set", "name_token_overlap", "addr_levenshtein", "addr_token_set", "combined_token_set", "country_exact_match", "bm25_name_score", "tfidf_name_score", "best_reciprocal_rank")


def _split_features(spark: SparkSession, d: str, columns: tuple[str, ...] | None = _COLUMNS) -> tuple[DataFrame, DataFrame]:
    f = writers.kept(main_features(spark, d, columns), "features")
    b = sampling.bucket("query_id")
    return f.where(b >= 20), f.where(b < 20)


def m4_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Scores of held-out pairs by boosted trees."""
    train, val = _split_features(spark, d)
    return models.predict(models.boosted(train, list(_COLUMNS), trees=10), val).select("query_id", "s1_id", "is_match", "score")


def m6_blend(spark: SparkSession, d: str) -> DataFrame:
    """Scores of held-out pairs by the weighted two-model blend."""
    train, val = _split_features(spark, d)
    first, second = models.at_once(spark, [lambda: models.boosted(train, list(_COLUMNS), negative=4.0, trees=10), lambda: models.forest(train, list(_COLUMNS), trees=10)])
    two = models.predict(second, models.predict(first, val, "p1"), "p2")
    return two.select("query_id", "s1_id", "is_match", models.blend(F.col("p1"), F.col("p2")).alias("score"))


def a15_importances(spark: SparkSession, d: str) -> DataFrame:
    train, _ = _split_features(spark, d)
    return models.importances(models.boosted(train, list(_COLUMNS), trees=5), list(_COLUMNS), spark)


def m10_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Ten stages of the main extractor's columns on one split."""
    train, val = _split_features(spark, d, None)
    ref, _, edges = party_sides(spark, d)
    mine = edges.where(sampling.bucket("query_id") < 20)
    return models.ablation(train, val, features.ablation_stages(), ref.select(F.col("entity_id").alias("s1_id")), mine)


def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """Exact-key decisions of queries replayed as a stream of files; equal to the batch result whatever the micro-batches."""
    ref, query, _ = sides(spark, d)
    keyed = lambda df, i: blocking.keyed(df, text.join_fields(text.normalize("business_name"), text.normalize("business_address")), i)
    at = f"{writers.shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    query.repartition(4).write.parquet(f"{at}/in")
    replay.replay(spark, f"{at}/in", query.schema, lambda b: blocking.unique_key(keyed(ref, "s1_id"), keyed(b, "query_id"))[0], f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("query_id", "s1_id")


def t4_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """Records in seeded order by source: the first hundred of each, the operator's sample size."""
    w = Window.partitionBy("source").orderBy("h", "entity_id")
    x = readers.records(spark, d).select("entity_id", F.substring("entity_id", 1, 2).alias("source"), sampling.shuffled("entity_id").alias("h"))
    return x.withColumn("position", F.row_number().over(w)).where("position <= 100").select("source", "entity_id", "position")


QUERIES = {f.__name__: f for f in (d_v1_main, d_v1_all, d_v2_hybrid, d_v3_sieve, d_v4_late, w2_runner_up, a5_entity_f, a6_macro_f, a6_macro_f_hybrid, a7_recall_at_k, a8_recall_slices, a9_errors, a10_singletons, a11_cardinality, a13_threshold_grid, a13_best_threshold, a14_log_loss, m8_ranking_loss, a3_source_profile, a4_truth_profile, sc3_coherent_sample, m1_split, m2_categories, m3_negatives, m7_triplets, sk1_collapsed, sk4_subset, m11_violations, pipeline_main, pipeline_sieve, pipeline_hybrid, pipeline_late, m4_boosted, m6_blend, a15_importances, m10_ablation, stream_replay, t4_shuffled)}

_P = f"WITH {sql.PAIRS}"
_BEST = "best AS (SELECT query_id, s1_id, score, lead(score) OVER w AS runner_up, row_number() OVER w AS rn FROM {} WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, s1_id))"
_OK = f"runner_up IS NULL OR score - runner_up >= {MARGIN}"
_V1 = f"passed AS (SELECT * FROM scored WHERE score >= {ABS}), {_BEST.format('passed')}, predicted AS (SELECT query_id, s1_id, score FROM best WHERE rn = 1 AND ({_OK}))"
_CNT = f"""{_V1}, cnt AS (SELECT entity_id AS s1_id, coalesce(t, 0) AS n_true, coalesce(p, 0) AS n_pred, coalesce(h, 0) AS n_hit FROM ref
  LEFT JOIN (SELECT s1_id, count(*) AS t FROM truth GROUP BY 1) x ON x.s1_id = entity_id LEFT JOIN (SELECT s1_id, count(*) AS p FROM predicted GROUP BY 1) y ON y.s1_id = entity_id
  LEFT JOIN (SELECT s1_id, count(*) AS h FROM predicted SEMI JOIN truth USING (s1_id, query_id) GROUP BY 1) z ON z.s1_id = entity_id)"""


def _prf(c: str = "cnt") -> str:
    case = lambda x: f"CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_hit = 0 THEN 0.0::DOUBLE ELSE {x} END"
    return f"prf AS (SELECT *, {case('n_hit / n_pred')} AS precision, {case('n_hit / n_true')} AS recall, {case('1.25 * (n_hit / n_pred) * (n_hit / n_true) / (0.25 * (n_hit / n_pred) + n_hit / n_true)')}::DOUBLE AS f FROM {c})"


_MD5 = lambda x: f"md5({x} || ':42')"
_BUCKET = lambda x: f"(('0x' || substr({_MD5(x)}, 1, 8))::BIGINT % 100)"
_S = f"WITH {sql.SIDES}"
_GRIDSQL = f"""{_P}, {_BEST.format("scored")}, b AS (SELECT * FROM best WHERE rn = 1), cells AS (SELECT a.abs, m.margin FROM (VALUES {", ".join(f"({x}::DOUBLE)" for x in ABSOLUTES)}) a(abs), (VALUES {", ".join(f"({x}::DOUBLE)" for x in MARGINS)}) m(margin)),
  pr AS (SELECT abs, margin, s1_id, count(*) AS p, count(truth.query_id) AS h FROM cells CROSS JOIN b LEFT JOIN truth USING (s1_id, query_id) WHERE score >= abs AND (margin = 0 OR runner_up IS NULL OR score - runner_up >= margin) GROUP BY ALL),
  cnt AS (SELECT c.abs, c.margin, r.entity_id, coalesce(t, 0) AS n_true, coalesce(p, 0) AS n_pred, coalesce(h, 0) AS n_hit FROM cells c CROSS JOIN ref r LEFT JOIN (SELECT s1_id, count(*) AS t FROM truth GROUP BY 1) x ON x.s1_id = r.entity_id
    LEFT JOIN pr ON pr.abs = c.abs AND pr.margin = c.margin AND pr.s1_id = r.entity_id), {_prf()},
  g AS (SELECT abs, margin, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f), 6) AS f FROM prf GROUP BY ALL)"""
_EXTEND = f"{_P}, {_V1}, found AS (SELECT query_id, s1_id FROM scored WHERE score >= 0.56)"
_LAB = "lab AS (SELECT s.*, (t.s1_id IS NOT NULL)::INT AS is_match, CASE WHEN score >= 0.575 THEN 'hard_lexical' WHEN score >= 0.555 THEN 'hard_address' WHEN score >= 0.53 THEN 'same_country' ELSE 'random' END AS category FROM scored s LEFT JOIN truth t USING (query_id, s1_id))"
_ROW = "SELECT query_id, s1_id, score FROM"


def _recall_sql() -> str:
    test = {"union": "least(br, tr) <= {}", "bm25": "br <= {}", "tfidf": "tr <= {}", "exact": "ex = 1"}
    rows = [f"SELECT '{c}' AS channel, {k} AS k, round(avg(CASE WHEN {t.format(k)} THEN 1.0 ELSE 0.0 END), 6) AS recall FROM h" for c, t in test.items() for k in (1, 5, 10, 20, 50)]
    rows.append("SELECT 'union', NULL, round(avg(CASE WHEN ex IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM h")
    return f"""{_P}, r AS (SELECT entity_id AS s1_id, business_name AS t FROM ref), q AS (SELECT entity_id AS query_id, business_name AS t FROM qry), {_bm25_sql(retrieval.MAIN, 3)}, {_tfidf_sql(20)},
        ex AS (SELECT y.entity_id AS query_id, x.entity_id AS s1_id FROM (SELECT *, count(*) OVER (PARTITION BY business_address) AS c FROM ref) x JOIN qry y USING (business_address) WHERE c <= 30),
        c AS (SELECT query_id, s1_id, max(e) AS ex, min(b) AS br, min(t) AS tr FROM (SELECT query_id, s1_id, 1 AS e, 999 AS b, 999 AS t FROM ex UNION ALL SELECT query_id, s1_id, 0, rank, 999 FROM bm UNION ALL SELECT query_id, s1_id, 0, 999, rank FROM tf) GROUP BY ALL),
        h AS (SELECT t.*, ex, br, tr FROM truth t LEFT JOIN c USING (s1_id, query_id)) {" UNION ALL ".join(rows)}"""


ORACLE = {
    "a7_recall_at_k": _recall_sql(),
    "d_v1_main": f"{_P}, {_V1} {_ROW} predicted",
    "d_v1_all": f"{_P} {_ROW} scored WHERE score >= {ABS}",
    "d_v2_hybrid": f"{_P}, {_BEST.format('scored')} {_ROW} best WHERE rn = 1 AND score >= {ABS} AND ({_OK})",
    "d_v3_sieve": f"""{_P}, locked AS (SELECT query_id, s1_id FROM truth JOIN (SELECT min_by(entity_id, key) AS query_id FROM qry GROUP BY business_address) USING (query_id)), rest AS (SELECT * FROM scored WHERE query_id NOT IN (SELECT query_id FROM locked)), {_BEST.format("rest")}
        SELECT query_id, s1_id, 1.0::DOUBLE AS score FROM locked UNION ALL {_ROW} best WHERE rn = 1 AND score >= {ABS} AND ({_OK})""",
    "d_v4_late": f"{_P}, {_BEST.format('scored')} {_ROW} best WHERE rn = 1 AND score >= {ABS}",
    "w2_runner_up": f"{_P}, {_BEST.format('scored')} SELECT query_id, s1_id, score, runner_up FROM best WHERE rn = 1",
    "a5_entity_f": f"{_P}, {_CNT}, {_prf()} SELECT s1_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f FROM prf",
    "a6_macro_f": f"{_P}, {_CNT}, {_prf()} SELECT count(*) AS n, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f), 4) AS f FROM prf",
    "a6_macro_f_hybrid": f"{_P}, {_CNT}, {_prf()} SELECT count(*) AS n, round(avg(precision), 5) AS precision, round(avg(CASE WHEN n_true = 0 THEN 1.0 ELSE recall END), 5) AS recall, round(avg(f), 5) AS f FROM prf",
    "a8_recall_slices": f"""{_P}, {_V1}, m AS (SELECT s1_id, count(*) AS m FROM truth GROUP BY 1), rows_ AS (SELECT t.s1_id, t.query_id, (p.s1_id IS NOT NULL)::INT AS hit, q.*, m FROM truth t JOIN m USING (s1_id) JOIN qry q ON q.entity_id = t.query_id LEFT JOIN predicted p ON p.s1_id = t.s1_id AND p.query_id = t.query_id),
        tall AS (SELECT hit, 'script' AS slice, 'Latin' AS value FROM rows_ UNION ALL SELECT hit, 'country', country FROM rows_ UNION ALL SELECT hit, 'missing', CASE WHEN business_name = '' AND business_address = '' THEN 'both' WHEN business_name = '' THEN 'name' WHEN business_address = '' THEN 'address' ELSE 'none' END FROM rows_
          UNION ALL SELECT hit, 'source', substr(entity_id, 1, 2) FROM rows_ UNION ALL SELECT hit, 'cardinality', CASE WHEN m > 1 THEN 'multi' ELSE 'one' END FROM rows_) SELECT slice, value, count(*) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS recall FROM tall GROUP BY ALL""",
    "a9_errors": f"""{_P}, {_V1}, found AS (SELECT query_id, s1_id FROM scored WHERE score >= 0.555)
        SELECT 'FALSE_NEGATIVE' AS error_type, CASE WHEN f.s1_id IS NULL THEN 'CANDIDATE_GENERATION_FAILURE' ELSE 'MATCHER_THRESHOLD_FAILURE' END AS failure_mechanism, t.query_id, t.s1_id, NULL AS predicted_s1_id FROM truth t ANTI JOIN predicted p USING (query_id, s1_id) LEFT JOIN found f ON f.query_id = t.query_id AND f.s1_id = t.s1_id
        UNION ALL SELECT 'FALSE_POSITIVE', 'WRONG_MERGE', p.query_id, NULL, p.s1_id FROM predicted p ANTI JOIN truth t USING (query_id, s1_id)""",
    "a10_singletons": f"{_P}, {_CNT}, k AS (SELECT CASE WHEN n_true = 0 THEN 'zero' WHEN n_true = 1 THEN 'one' ELSE 'multi' END AS kind, (n_true = n_pred AND n_hit = n_true)::INT AS ok FROM cnt) SELECT kind, count(*) AS n, sum(ok)::BIGINT AS correct, round(avg(ok), 6) AS accuracy FROM k GROUP BY 1",
    "a11_cardinality": f"{_P}, {_CNT} SELECT count(*) FILTER (n_pred = 0) AS zero, count(*) FILTER (n_pred = 1) AS single, count(*) FILTER (n_pred > 1) AS multi FROM cnt",
    "a13_threshold_grid": f"{_GRIDSQL} SELECT * FROM g",
    "a13_best_threshold": f"{_GRIDSQL} SELECT * FROM g ORDER BY f DESC, abs, margin LIMIT 1",
    "a14_log_loss": f"{_P}, {_LAB} SELECT round(avg(-CASE WHEN is_match = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM (SELECT is_match, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM lab)",
    "m8_ranking_loss": f"{_P}, {_LAB} SELECT query_id, round(greatest(0.0, 0.2 - p + n), 6) AS loss FROM (SELECT query_id, max(score) FILTER (is_match = 1) AS p, max(score) FILTER (is_match = 0) AS n FROM lab GROUP BY 1) WHERE p IS NOT NULL AND n IS NOT NULL",
    "a3_source_profile": f"""WITH {sql.RECORDS}, t AS (SELECT count(*) AS rows FROM records), s AS (SELECT *, {sql.script("business_name")} AS script FROM records),
        u AS (SELECT 'rows' AS metric, '' AS value, count(*) AS n FROM s UNION ALL SELECT 'distinct_ids', '', count(DISTINCT entity_id) FROM s UNION ALL SELECT 'missing', 'business_name', count(*) FILTER (business_name = '') FROM s UNION ALL SELECT 'missing', 'business_address', count(*) FILTER (business_address = '') FROM s
          UNION ALL SELECT 'missing', 'country', count(*) FILTER (country = '') FROM s UNION ALL SELECT 'country', country, count(*) FROM s GROUP BY country UNION ALL SELECT 'script', script, count(*) FROM s GROUP BY script) SELECT metric, value, n, round(n * 100.0 / rows, 4)::DOUBLE AS pct FROM u, t""",
    "a4_truth_profile": f"""{_S}, m AS (SELECT entity_id, count(t.query_id) AS m FROM ref LEFT JOIN truth t ON t.s1_id = entity_id GROUP BY 1)
        SELECT count(*) AS n, count(*) FILTER (m = 0) AS zero, count(*) FILTER (m = 1) AS one, count(*) FILTER (m > 1) AS multi, round(avg(CASE WHEN m = 0 THEN 100.0 ELSE 0 END), 4) AS zero_pct, round(avg(CASE WHEN m = 1 THEN 100.0 ELSE 0 END), 4) AS one_pct, round(avg(CASE WHEN m > 1 THEN 100.0 ELSE 0 END), 4) AS multi_pct,
        round(avg(m), 6) AS avg_matches, max(m) AS max_matches FROM m""",
    "sc3_coherent_sample": f"""{_P}, rs AS (SELECT entity_id FROM ref ORDER BY entity_id LIMIT 200), es AS (SELECT * FROM truth WHERE s1_id IN (SELECT entity_id FROM rs)), tg AS (SELECT DISTINCT query_id, {_MD5("query_id")} AS h FROM es ORDER BY h, query_id LIMIT 50),
        ot AS (SELECT entity_id FROM qry WHERE entity_id NOT IN (SELECT query_id FROM truth) ORDER BY entity_id LIMIT 30)
        SELECT 'reference' AS part, entity_id FROM rs UNION ALL SELECT 'query', entity_id FROM qry WHERE entity_id IN (SELECT query_id FROM tg) OR entity_id IN (SELECT entity_id FROM ot)""",
    "m1_split": f"""{_P}, o AS (SELECT q.entity_id, CASE WHEN t.s1_id IS NOT NULL THEN {_BUCKET("t.s1_id")} ELSE {_BUCKET("q.entity_id")} END AS b FROM qry q LEFT JOIN (SELECT query_id, min(s1_id) AS s1_id FROM truth GROUP BY 1) t ON t.query_id = q.entity_id)
        SELECT CASE WHEN {_BUCKET("entity_id")} < 20 THEN 'val_reference' ELSE 'train_reference' END AS part, entity_id AS id FROM ref UNION ALL SELECT CASE WHEN b < 20 THEN 'val_query' ELSE 'train_query' END, entity_id FROM o
        UNION ALL SELECT CASE WHEN {_BUCKET("s1_id")} < 20 THEN 'val_edges' ELSE 'train_edges' END, s1_id || '+' || query_id FROM truth""",
    "m3_negatives": f"""{_P}, {_LAB}, n AS (SELECT count(*) FILTER (is_match = 1) AS pos, count(*) FILTER (is_match = 0) AS neg FROM lab), h AS (SELECT *, md5(query_id || ':' || s1_id || ':42') AS h FROM lab),
        r AS (SELECT h.*, row_number() OVER (PARTITION BY category ORDER BY h, query_id, s1_id) AS rn, least(neg, 2 * pos) AS target FROM h, n WHERE is_match = 0),
        k AS (SELECT *, rn <= floor(target * CASE category WHEN 'hard_lexical' THEN 0.35 WHEN 'hard_address' THEN 0.25 WHEN 'hard_retrieval' THEN 0.2 ELSE 0.1 END + 1e-9) AS took FROM r),
        f AS (SELECT *, row_number() OVER (ORDER BY h, query_id, s1_id) AS o FROM k WHERE NOT took)
        SELECT query_id, s1_id, is_match FROM lab WHERE is_match = 1 UNION ALL SELECT query_id, s1_id, is_match FROM k WHERE took UNION ALL SELECT query_id, s1_id, is_match FROM f WHERE o <= target - (SELECT count(*) FROM k WHERE took)""",
    "m7_triplets": f"""{_P}, n AS (SELECT query_id, s1_id, md5(query_id || ':' || s1_id || ':42') AS h FROM pairs ANTI JOIN truth USING (query_id, s1_id)), o AS (SELECT query_id, s1_id AS negative_id FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY h, s1_id) = 1)
        SELECT query_id, s1_id AS positive_id, negative_id FROM truth JOIN o USING (query_id)""",
    "sk1_collapsed": f"{_P}, {_V1} SELECT entity_id AS source1_entity_id, coalesce(string_agg(query_id, ',' ORDER BY query_id), '') AS matched_entity_ids FROM ref LEFT JOIN predicted ON s1_id = entity_id GROUP BY 1",
    "sk4_subset": f"{_EXTEND} SELECT 'kept' AS part, s1_id, query_id FROM predicted SEMI JOIN found USING (s1_id, query_id) UNION ALL SELECT 'extended', s1_id, query_id FROM (SELECT s1_id, query_id FROM found UNION SELECT s1_id, query_id FROM predicted)",
    "m11_violations": rf"""{_P}, {_V1}, res AS (SELECT entity_id AS s1_id, coalesce(string_agg(query_id, ',' ORDER BY query_id), '') AS ids FROM ref LEFT JOIN predicted ON s1_id = entity_id GROUP BY 1),
        k AS (SELECT *, regexp_extract(s1_id, '\d+$')::BIGINT % 97 AS m FROM res), bad AS (SELECT s1_id, CASE WHEN m = 1 THEN 'S2-4,S2-4' WHEN m = 2 THEN s1_id WHEN m = 3 THEN 'X-1' ELSE ids END AS ids FROM k WHERE m <> 5),
        x AS (SELECT * FROM bad UNION ALL SELECT s1_id, ids FROM k WHERE m = 7), e AS (SELECT s1_id, unnest(list_filter(string_split(ids, ','), lambda w: w <> '')) AS id FROM x),
        d AS (SELECT bad.s1_id, list_sort(list_distinct(list_filter(string_split(bad.ids, ','), lambda w: w <> '' AND NOT list_contains(string_split(res.ids, ','), w)))) AS extra FROM bad JOIN res USING (s1_id))
        SELECT 'matching' AS file, 'duplicate_row' AS rule, s1_id, count(*)::VARCHAR AS detail FROM x GROUP BY s1_id HAVING count(*) > 1 UNION SELECT 'matching', 'duplicate_id', s1_id, id FROM e GROUP BY s1_id, id HAVING count(*) > 1
        UNION SELECT 'matching', 'self_match', s1_id, id FROM e WHERE id = s1_id UNION SELECT 'matching', 'wrong_prefix', s1_id, id FROM e WHERE NOT regexp_matches(id, '^S[23]-') AND id <> s1_id
        UNION SELECT 'matching', 'missing_row', entity_id, '' FROM ref WHERE entity_id NOT IN (SELECT s1_id FROM x) UNION SELECT 'matching', 'not_a_subset', s1_id, array_to_string(extra, ',') FROM d WHERE len(extra) > 0""",
    "stream_replay": f"""{_S}, r AS (SELECT entity_id AS s1_id, trim({sql.norm("business_name")} || ' ' || {sql.norm("business_address")}) AS k FROM ref), q AS (SELECT entity_id AS query_id, trim({sql.norm("business_name")} || ' ' || {sql.norm("business_address")}) AS k FROM qry)
        SELECT query_id, s1_id FROM q JOIN (SELECT k, min(s1_id) AS s1_id FROM r WHERE k <> '' GROUP BY k HAVING count(*) = 1) USING (k)""",
    "t4_shuffled": f"WITH {sql.RECORDS} SELECT substr(entity_id, 1, 2) AS source, entity_id, row_number() OVER (PARTITION BY substr(entity_id, 1, 2) ORDER BY {_MD5('entity_id')}, entity_id) AS position FROM records QUALIFY position <= 100",
}
