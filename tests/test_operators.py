import random

import numpy as np
import pytest
from kindred.operators import assign, blocking, candidates, features, metrics, models, retrieval, sampling, validate
from kindred.plans import pipelines
from kindred.sources import readers, writers
from pyspark.sql import functions as F

REC = "entity_id string, business_name string, business_address string, country string"


def pairs(spark, rows):
    return spark.createDataFrame(rows, "query_id string, s1_id string, score double")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_margin_variants(spark):
    x = pairs(spark, [("q", "a", 0.60), ("q", "b", 0.45), ("r", "a", 0.9)])
    assert got(assign.main(x, 0.5, 0.2), "query_id", "s1_id") == [("q", "a"), ("r", "a")]
    assert got(assign.hybrid(x, 0.5, 0.2), "query_id", "s1_id") == [("r", "a")]
    assert got(assign.late(x, 0.5, 0.0), "query_id", "s1_id") == [("q", "a"), ("r", "a")]
    locked = spark.createDataFrame([("q", "z")], "query_id string, s1_id string")
    assert got(assign.sieve(locked, x, 0.5, 0.2), "query_id", "s1_id") == [("q", "z"), ("r", "a")]


def test_ties_go_to_the_lower_id(spark):
    x = pairs(spark, [("q", "b", 0.7), ("q", "a", 0.7)])
    assert got(assign.main(x, 0.5, 0.0), "s1_id") == [("a",)]
    assert got(assign.main(x, 0.5, 0.1), "s1_id") == []


def edges(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, query_id string")


def test_entity_f(spark):
    ids = spark.createDataFrame([(c,) for c in "abcd"], "s1_id string")
    t, p = edges(spark, [("c", "1"), ("c", "2"), ("d", "3")]), edges(spark, [("b", "9"), ("c", "1")])
    f = {r.s1_id: round(r.f, 4) for r in metrics.scored(metrics.counts(ids, t, p)).collect()}
    assert f == {"a": 1.0, "b": 0.0, "c": 0.8333, "d": 0.0}
    m = metrics.macro(metrics.counts(ids, t, p), singletons_recalled=True).first()
    assert m.n == 4 and m.recall == pytest.approx((1 + 1 + 0.5 + 0) / 4)


def test_grid_equals_cells(spark):
    ids = spark.createDataFrame([(c,) for c in "ab"], "s1_id string")
    t = edges(spark, [("a", "1")])
    s = pairs(spark, [("1", "a", 0.8), ("1", "b", 0.79), ("2", "b", 0.6)])
    for r in metrics.grid(ids, t, assign.best_two(s), (0.5, 0.7), (0.0, 0.05)).collect():
        one = metrics.macro(metrics.counts(ids, t, assign.late(s, r.abs, r.margin)), digits=6).first()
        assert (r.precision, r.recall, r.f) == (one.precision, one.recall, one.f)


def test_recall_at_k(spark):
    c = candidates.merged({"exact_name": pairs(spark, [("1", "a", 0.0)]).drop("score"), "bm25_name": pairs(spark, [("2", "b", 3.0)]).withColumn("rank", F.lit(2))})
    t = edges(spark, [("a", "1"), ("b", "2"), ("c", "3")])
    r = {(x.channel, x.k): x.recall for x in metrics.recall_at(t, c, (1, 5)).collect()}
    assert r["union", 1] == 0.0 and r["union", 5] == round(1 / 3, 6) and r["exact", 1] == round(1 / 3, 6) and r["union", None] == round(2 / 3, 6)
    assert {x.recall for x in metrics.recall_at(t.limit(0), c, (1,)).collect()} == {1.0}


def test_exact_caps(spark):
    ref = spark.createDataFrame([("a", "k", 1), ("b", "k", 2), ("c", "m", 3)], "s1_id string, key string, first int")
    q = spark.createDataFrame([("1", "k"), ("2", "m"), ("3", "")], "query_id string, key string")
    assert got(blocking.exact(ref.drop("first"), q, 1), "query_id", "s1_id") == [("2", "c")]
    assert got(blocking.truncated(ref, q, 1), "query_id", "s1_id") == [("1", "a"), ("2", "c")]
    hit, rest = blocking.unique_key(ref, q)
    assert got(hit, "query_id", "s1_id") == [("2", "c")] and got(rest, "query_id") == [("1",), ("3",)]


def test_country_wildcard(spark):
    q = spark.createDataFrame([("1", "", "", "FR"), ("2", "", "", "")], REC)
    s = spark.createDataFrame([("a", "", "", "fr"), ("b", "", "", "US")], REC)
    x = spark.createDataFrame([(i, j) for i in "12" for j in "ab"], "query_id string, s1_id string")
    assert got(blocking.country_block(x, q, s), "query_id", "s1_id") == [("1", "a"), ("2", "a"), ("2", "b")]


def test_bm25_of_stop_words_only(spark):
    s = spark.createDataFrame([("a", "the of"), ("b", "the and")], "entity_id string, t string")
    q = spark.createDataFrame([("1", "of")], "entity_id string, t string")
    assert got(retrieval.bm25_top(s, q, "t", 3), "s1_id", "rank") == [("a", 1)]


def test_boundary_grams(spark):
    g = spark.createDataFrame([("ab cde",)], "t string").select(retrieval.boundary_grams(F.col("t")).alias("g")).first().g
    assert sorted(g) == sorted([" ab", "ab ", " ab ", " cd", "cde", "de ", " cde", "cde ", " cde "])


def test_merge_defaults(spark):
    c = candidates.merged({"exact_name": pairs(spark, [("1", "a", 0.0)]).drop("score")}).first()
    assert (c.by_exact_name, c.retrieval_agreement_count, c.best_retrieval_rank, c.best_reciprocal_rank, c.bm25_name_rank) == (1, 1, 999, 0.0, 999)


def test_priority_fill(spark):
    first = spark.createDataFrame([("q", x, i) for i, x in enumerate("abc")], "query_id string, s1_id string, position int")
    second = spark.createDataFrame([("q", x, 1.0, i) for i, x in enumerate("cde", 1)], "query_id string, s1_id string, score double, rank int")
    out = candidates.priority_fill([(first, 10.0), (second, None)], 4)
    assert got(out, "s1_id", "score", "rank") == [("a", 10.0, 1), ("b", 10.0, 2), ("c", 10.0, 3), ("d", 1.0, 4)]
    assert len(candidates.priority_fill([(first, 10.0), (second, None)], 2).collect()) == 3


def test_split_is_disjoint(spark):
    ref = spark.createDataFrame([(f"S1-{i}", "", "", "") for i in range(60)], REC)
    q = spark.createDataFrame([(f"S2-{i}", "", "", "") for i in range(80)], REC)
    t = edges(spark, [(f"S1-{i}", f"S2-{i}") for i in range(60)])
    s = {k: {r[0] for r in v.collect()} for k, v in sampling.split(ref, q, t).items()}
    for kind in ("reference", "query"):
        assert not s[f"train_{kind}"] & s[f"val_{kind}"]
    assert len(s["train_query"] | s["val_query"]) == 80
    dropped = sampling.split(ref, q, t, unmatched="drop")
    assert dropped["train_query"].count() + dropped["val_query"].count() == 60


def test_negatives(spark):
    rows = [("q", f"s{i}", int(i == 0), "random") for i in range(30)]
    f = spark.createDataFrame(rows, "query_id string, s1_id string, is_match int, category string")
    assert sampling.negatives(f).where("is_match = 0").count() == 8
    assert sampling.negatives(f.where("is_match = 0")).count() == 29


def test_reader_keeps_literals(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t NA \t"x\tnull\nS1-2\t\t\t\n', encoding="utf-8")
    rows = {r.entity_id: tuple(r)[1:] for r in readers.record_file(spark, str(p)).collect()}
    assert rows == {"S1-1": ("NA", '"x', "null"), "S1-2": ("", "", "")}
    p.write_text("entity_id\nS1-1\n")
    with pytest.raises(ValueError, match="business_name"):
        readers.record_file(spark, str(p))
    assert readers.record_file(spark, str(p), required=False).first().country == ""


def test_truth_round_trip(spark, tmp_path):
    ref = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    e = edges(spark, [("S1-1", "S2-9"), ("S1-1", "S2-10"), ("S1-1", "S2-9")])
    writers.write_tsv(writers.collapsed(ref, e, order="entity_id"), str(tmp_path / "o"), str(tmp_path / "p"))
    assert got(readers.truth_file(spark, str(tmp_path / "o")), "s1_id", "query_id") == [("S1-1", "S2-10"), ("S1-1", "S2-9")]
    assert got(readers.reverse_map(e), "query_id", "s1_id") == [("S2-10", "S1-1"), ("S2-9", "S1-1")]


def test_thresholds(tmp_path):
    p = str(tmp_path / "t.json")
    assert writers.load_thresholds(p)["abs_threshold"] == 0.65
    writers.save_thresholds(p, 0.5, 0.1)
    assert (writers.load_thresholds(p)["abs_threshold"], writers.load_thresholds(p)["margin_threshold"]) == (0.5, 0.1)


def test_validator(spark):
    ref = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    x = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-1,Q-1"), ("S1-2", ""), ("S1-2", ""), ("S1-9", "S3-7")], "s1_id string, ids string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    rules = {(r.rule, r.s1_id) for r in validate.lists(x, ref, "matching", known).collect()}
    assert rules == {("duplicate_id", "S1-1"), ("self_match", "S1-1"), ("wrong_prefix", "S1-1"), ("duplicate_row", "S1-2"), ("missing_row", "S1-3"), ("unknown_row", "S1-9"), ("unknown_id", "S1-1"), ("unknown_id", "S1-9")}
    c = spark.createDataFrame([("S1-9", "S3-8")], "s1_id string, ids string")
    assert got(validate.subset(x.where("s1_id = 'S1-9'"), c), "rule", "detail") == [("not_a_subset", "S3-7")]
    lines = spark.createDataFrame([("a,b",), ("x\ty\tz",)], "value string")
    assert got(validate.header(lines, "matching", "a,b"), "rule") == [("malformed_row",), ("not_tab_separated",)]


def test_models_learn(spark):
    df = spark.createDataFrame([(f"q{i}", f"s{i}", float(i % 10), int(i % 10 > 5)) for i in range(200)], "query_id string, s1_id string, x double, is_match int")
    out = models.predict(models.boosted(df, ["x"], trees=3), df)
    assert out.where("(score > 0.5) <> (is_match = 1)").count() == 0


def test_pipelines_link_the_obvious(spark):
    ref = spark.createDataFrame([("S1-1", "Alpha Widgets Ltd", "12 High Road", "GB"), ("S1-2", "Beta Gears", "9 Low Road", "GB"), ("S1-3", "Gamma Mills", "77 Mid Road", "GB"), ("S1-4", "Delta Farms", "5 End Road", "GB")], REC)
    q = spark.createDataFrame([("S2-1", "Alpha Widgets Limited", "12 High Rd", "GB"), ("S3-2", "Beta Gears", "9 Low Road", "GB")], REC)
    want = [("S1-1", "S2-1"), ("S1-2", "S3-2")]
    assert got(pipelines.sieve(ref, q, F.col("comb_set"))[0], "s1_id", "query_id") == want
    assert got(pipelines.late(ref, q, 0.5, 0.0)[0], "s1_id", "query_id") == want
    assert got(pipelines.main(ref, q, F.col("weighted_composite_similarity"), 0.5, 0.0)[0], "s1_id", "query_id") == want


def test_features_have_their_columns(spark, small):
    from kindred.plans import registry

    assert len(registry.QUERIES["f7_main_features"](spark, small).columns) == 61 + 3
    assert len(registry.QUERIES["f8_hybrid_features"](spark, small).columns) == 30 + 2
    assert len(registry.QUERIES["f11_sieve_features"](spark, small).columns) == 28 - 3 + 3 + 3


def test_stream_does_not_depend_on_batches(spark, tmp_path):
    from kindred.streaming import replay

    q = spark.range(40).selectExpr("cast(id as string) as query_id", "id % 7 as k")
    q.repartition(8).write.parquet(str(tmp_path / "in"))
    for files in (1, 8):
        replay.replay(spark, str(tmp_path / "in"), q.schema, lambda b: b.where("k = 3"), str(tmp_path / f"out{files}"), str(tmp_path / f"state{files}"), files)
    a, b = (got(spark.read.parquet(str(tmp_path / f"out{n}")), "query_id") for n in (1, 8))
    assert a == b and len(a) == 6


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_files_are_discovered(spark, tmp_path):
    for name in ("a/data/train/train_source1.tsv", "a/data/train/x_source2_v1.tsv", "a/data/test/test_source1.tsv", "a/data/train/train_ground_truth.tsv", "b/train_source1.tsv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("entity_id\n")
    got = readers.discovered(spark, str(tmp_path))
    assert {k: v.rpartition("/")[2] for k, v in got.items()} == {"train_source1": "train_source1.tsv", "train_source2": "x_source2_v1.tsv", "train_ground_truth": "train_ground_truth.tsv", "test_source1": "test_source1.tsv"}
    flat = readers.discovered(spark, str(tmp_path / "b"))
    assert list(flat) == ["train_source1"] and readers.discovered(spark, str(tmp_path / "none")) == {}


def test_by_source_prunes(spark):
    records = spark.createDataFrame([("S1-1", "a"), ("S2-1", "b"), ("S3-1", "c")], "entity_id string, business_name string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "entity_id string")
    assert [r.entity_id for r in readers.by_source(records, ids("S2-1", "S2-9")).collect()] == ["S2-1"]
    none = readers.by_source(records, ids())
    assert none.columns == records.columns and none.count() == 0


def test_split_presets(spark):
    reference = spark.createDataFrame([(f"S1-{i}",) for i in range(400)], "entity_id string")
    query = spark.createDataFrame([(f"S2-{i}",) for i in range(800)], "entity_id string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(400)], "s1_id string, query_id string")
    for name, (val, rest) in sampling.SPLITS.items():
        got = {k: {r[0] for r in v.select(v.columns[-1] if k.endswith("edges") else "entity_id").collect()} for k, v in sampling.split(reference, query, truth, val, rest).items()}
        assert not got["train_query"] & got["val_query"] and not got["train_reference"] & got["val_reference"]
        free = {side: sum(int(q[3:]) >= 400 for q in got[f"{side}_query"]) for side in ("train", "val")}
        assert {"split": free["train"] + free["val"] == 400 and free["val"] < 120, "drop": free == {"train": 0, "val": 0}, "halve": free["train"] + free["val"] == 400 and 150 < free["val"] < 250}[rest], name
        assert abs(len(got["val_reference"]) - 4 * val) < 30
    late = sampling.split_fixed(reference, query, truth, (30, 50))
    assert (late["train_reference"].count(), late["val_reference"].count(), late["val_query"].count()) == (30, 50, 50)


def test_boosting_stops_early(spark):
    rng = random.Random(3)
    rows = [(float(i % 2) + rng.random() * 0.1, rng.randint(0, 1) if i % 5 == 0 else i % 2, i % 5 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, is_match int, held boolean")
    whole = models.boosted(df, ["x"], trees=12).stages[-1].getNumTrees
    assert models.boosted(df, ["x"], trees=12, validation="held").stages[-1].getNumTrees < whole == 12


@pytest.mark.parametrize("chunk,rows,queries", [(4096, 65_536, 2048), (3, 7, 4)])
def test_dense_top_against_plain(spark, monkeypatch, chunk, rows, queries):
    """Blocks of any size give what all pairs give; ties, copies, null ids, odd lengths and nulls included."""
    for name, value in (("DENSE_CHUNK", chunk), ("DENSE_ROWS", rows), ("DENSE_QUERIES", queries)):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(5)
    vec = lambda n=3: [float(rng.randint(-2, 2)) for _ in range(n)]
    refs = [(i, vec()) for i in range(40)] + [(100 + i, [1.0, 1.0, 1.0]) for i in range(9)] + [(200, vec(2)), (201, None), (202, []), (203, [1.0, None, 1.0]), (None, [2.0, 2.0, 2.0])]
    asks = [(i, vec()) for i in range(11)] + [(50, [1.0, 0.0]), (51, None), (52, [None, 1.0, 1.0]), (None, vec())]
    want = []
    ok = lambda v: bool(v) and None not in v
    for qi, q in asks:
        if qi is not None and ok(q):
            near = sorted((-sum(x * y for x, y in zip(q, v)), i) for i, v in refs if i is not None and ok(v) and len(v) == len(q))
            want += [(qi, i, -s, n) for n, (s, i) in enumerate([x for x in near if -x[0] > 0][:5], 1)]
    found = retrieval.dense_top(spark.createDataFrame(asks, "query_id long, q array<double>"), spark.createDataFrame(refs, "s1_id long, v array<double>"), 5)
    assert got(found, "query_id", "s1_id", "score", "rank") == sorted(want)
    none = spark.createDataFrame([], "s1_id long, v array<double>")
    assert retrieval.dense_top(spark.createDataFrame(asks, "query_id long, q array<double>"), none, 5).count() == 0


def test_ablation_stages_grow_to_all_columns(spark):
    stages = features.ablation_stages()
    assert [len(c) for c in stages.values()] == [5, 11, 11, 22, 25, 27, 30, 36, 42, 61]
    ref, query = (spark.createDataFrame([(i, "Acme Ltd", "1 Main St", "US")], REC) for i in ("S1-1", "S2-1"))
    pair = spark.createDataFrame([("S2-1", "S1-1")], "query_id string, s1_id string").withColumns({c: F.lit(0) for c in features.RETRIEVAL})
    made = features.main(pair, features.prepared(query), features.prepared(ref))
    assert sorted(stages["full"]) == sorted(set(made.columns) - {"query_id", "s1_id"})


def test_block_leaves_out_only_what_cannot_win():
    """The k best of every query as by brute force, ties by record, though most postings are never looked at (F6)."""
    rng = np.random.RandomState(1)
    rows = [np.unique(np.concatenate([np.arange(12), 12 + rng.randint(0, 40, 3), 52 + rng.randint(0, 3000, 4)])) for _ in range(4000)]
    size, term = np.array([len(r) for r in rows]), np.concatenate(rows)
    weight = np.where(term < 12, 0.05, np.where(term < 52, 0.2, 1.0)) * rng.choice([0.5, 1.0], len(term))
    block = retrieval.Block(size, term, weight)
    dense = np.zeros((len(rows), 3100))
    dense[np.repeat(np.arange(len(rows)), size), term] = weight
    asked = [np.unique(np.concatenate([r, [3090]])) for r in rows[::40]] + [np.array([3, 5]), np.array([20]), np.array([3095]), np.array([], int), rows[0][rows[0] >= 52]]
    for t in asked:
        for k, floor in ((1, 0.001), (5, 0.001), (5, 1.2), (4000, 0.0)):
            factor = 0.5 + t % 3 / 4
            score = np.round(dense[:, t] @ factor, 6)
            best = [i for i in np.lexsort((np.arange(len(score)), -score)) if score[i] > floor][:k]
            some, got = block.top(t, factor, k, floor)
            order = np.lexsort((some, -got))
            assert some[order].tolist() == best and np.allclose(got[order], score[best], atol=2e-6)
    block.looked = 0
    for t in asked[:100]:
        block.top(t, np.ones(len(t)), 3, 0.001)
    assert block.looked < 0.1 * sum(block.df[np.searchsorted(block.terms, t[t < 3090])].sum() for t in asked[:100])


def test_grams_of_a_word(spark):
    """The plain grams against the expression, and a repeated id's rows as one."""
    words = ["a", "ab", "abc", "abcdé", "日本", "𐐀b"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", retrieval.boundary_grams(F.col("t")).alias("g")).collect()
    assert all(sorted(r.g) == sorted(retrieval.word_grams(r.t.lower())) for r in got)
    rows = retrieval.gram_counts(spark.createDataFrame([("x", "Ab"), ("x", "ab c"), ("y", " "), ("z", None)], "entity_id string, t string"), "t", "i").collect()
    assert [(r.i, {t: round(n, 6) for t, n in zip(r.term, r.tf)}) for r in rows] == [("x", {" ab": 1.693147, "ab ": 1.693147, " ab ": 1.693147, " c ": 1.0})]
