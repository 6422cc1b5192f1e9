"""What decides the time of the model queries on large tables: work that is done once, dealt evenly, and only where wanted."""

import threading
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from kindred.operators import boosting, features, models, retrieval, sampling
from kindred.plans import decision_queries, pair_queries
from kindred.sources import readers, writers
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_channels_are_searched_once(spark, small):
    """Candidates are read twice (to find the true pairs they lack); a search left in the plan would run twice (F1)."""
    got = pair_queries.main_features(spark, small)
    assert "FlatMapCoGroups" not in plan(got) and got.groupBy("query_id", "s1_id").count().where("count > 1").isEmpty()


def test_wanted_features_are_those_of_all(spark, monkeypatch):
    """Some columns are what they are among all, and no other similarity is computed for them (F1)."""
    rec = "entity_id string, business_name string, business_address string, country string"
    ref = spark.createDataFrame([("S1-1", "Acme Tools Ltd", "1 Main St", "US"), ("S1-2", "Bolt", "", "US"), ("S1-3", None, "2 Side Rd", None)], rec)
    query = spark.createDataFrame([("S2-1", "Tools Acme", "Main Street 1", "US"), ("S3-2", "", "2 Side Rd", "DE")], rec)
    pairs = spark.createDataFrame([(q, s) for q in ("S2-1", "S3-2", "S2-9") for s in ("S1-1", "S1-2", "S1-3")], "query_id string, s1_id string").withColumns({c: F.lit(1) for c in features.RETRIEVAL})
    sides = features.prepared(query), features.prepared(ref)
    whole = features.main(pairs, *sides)
    for wanted in (decision_queries._COLUMNS, ("weighted_composite_similarity",), ("addr_partial_ratio",), ("by_bm25_name",), whole.columns[2:]):
        some = features.main(pairs, *sides, columns=wanted)
        keep = [c for c in whole.columns if c in ("query_id", "s1_id", *wanted)]
        assert some.columns == keep
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(keep).collect())), wanted
    made = []
    fuzzy = features.similarity.fuzzy
    monkeypatch.setattr(features.similarity, "fuzzy", lambda a, b, *names: made.append(names) or fuzzy(a, b, *names))
    features.main(pairs, *sides, columns=decision_queries._COLUMNS)
    assert made == [("jaro_winkler", "token_set"), ("token_set",), ("token_set",)]


@pytest.mark.parametrize("query", ["a15_importances", "m6_blend"])
def test_models_write_the_features_they_fit(spark, small, monkeypatch, query):
    """Not all 61: what is written and read again for each fit are the model's eleven (F3, F5)."""
    written, kept = {}, writers.kept
    monkeypatch.setattr(writers, "kept", lambda df, name: written.update({name: df.columns}) or kept(df, name))
    assert decision_queries.QUERIES[query](spark, small).count() > 0
    assert sorted(written["features"]) == sorted(("query_id", "s1_id", "is_match", *decision_queries._COLUMNS))


def test_nations_go_to_the_parties(spark, small):
    """Without a hint the parties were broadcast to the nations' single task, which then did all that followed (F4)."""
    assert "rightHint=(strategy=broadcast)" in plan(readers.parties(spark, small))


def test_ablation_fits_at_a_time(spark, monkeypatch):
    """Two fits meet while they run, and the stages keep their order and their own models (F4)."""
    rows = [(f"S2-{i}", f"S1-{i % 50}", i % 2, float(i % 2), float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "query_id string, s1_id string, is_match int, x double, y double")
    truth = df.where("is_match = 1").select("s1_id", "query_id")
    ids = df.select("s1_id").distinct()
    meet, boosted = threading.Barrier(2), models.boosted
    monkeypatch.setattr(models, "boosted", lambda *a, **k: meet.wait(60) is not None and boosted(*a, **k))
    got = [tuple(r) for r in models.ablation(df, df, {"x": ["x"], "y": ["y"], "both": ["x", "y"], "again": ["x"]}, ids, truth, trees=2).collect()]
    assert [r[:2] for r in got] == [("x", 1), ("y", 1), ("both", 2), ("again", 1)]
    assert got[0][2:] == got[3][2:] == (1.0, 1.0, 1.0) and got[1][4] < 1


def test_ablation_fits_whole_models(spark, small, monkeypatch):
    """Every stage is fitted with the main variant's 500 trees at a rate of 0.05, fewer only once 40 have not helped; it was 5 at 0.1 (F1)."""
    asked, scores, boosted = {}, boosting.scores, []
    monkeypatch.setattr(boosting, "scores", lambda rows, columns, *how: asked.update({tuple(columns): how}) or scores(rows, columns, *how))
    monkeypatch.setattr(models, "boosted", lambda *a, **k: boosted.append(a))
    got = decision_queries.m10_ablation(spark, small).collect()
    stages = features.ablation_stages()
    assert [(r.stage, r.features) for r in got] == [(s, len(c)) for s, c in stages.items()]
    assert asked == {tuple(c): (500, 0.05, 40) for c in stages.values()} and not boosted


def _plain_boost(x, y, xv, yv, trees, rate, patience):
    """Boosting by sums over rows of every leaf, column and bin."""
    odds = lambda v: 1 / (1 + np.exp(-v))
    f, fv = (np.full(len(v), np.log(y.mean() / (1 - y.mean()))) for v in (y, yv))
    best, least, n, m = fv.copy(), np.inf, 0, 0
    while m < trees and m - n < patience:
        m += 1
        g, h = odds(f) - y, odds(f) * (1 - odds(f))

        def split(of):
            G, H, found = g[of].sum(), h[of].sum(), (1e-12, None, None)
            for c in range(len(x)):
                for b in range(x.max() + 1):
                    low, high = of & (x[c] <= b), of & (x[c] > b)
                    if min(h[low].sum(), h[high].sum()) >= max(1e-3, (boosting.LEAF_ROWS - 0.5) * H / of.sum()):
                        gain = g[low].sum() ** 2 / h[low].sum() + g[high].sum() ** 2 / h[high].sum() - G**2 / H
                        found = (gain, c, b) if gain > found[0] + 1e-12 else found
            return found

        leaves = [(np.ones(len(y), bool), np.ones(len(yv), bool))]
        cuts = [split(leaves[0][0])]
        while len(leaves) < boosting.LEAVES and max(cuts, key=lambda v: v[0])[1] is not None:
            i = max(range(len(cuts)), key=lambda j: cuts[j][0])
            (of, held), (_, c, b) = leaves.pop(i), cuts.pop(i)
            for side in (True, False):
                leaves.append((of & ((x[c] <= b) == side), held & ((xv[c] <= b) == side)))
                cuts.append(split(leaves[-1][0]))
        for of, held in leaves:
            value = -g[of].sum() / h[of].sum()
            f[of] += rate * value
            fv[held] += rate * value
        loss = np.mean(np.log1p(np.exp(fv)) - yv * fv)
        if loss < least:
            best, least, n = fv.copy(), loss, m
    return best, n, m


@pytest.mark.parametrize("cells", [0, 1 << 16])
def test_boosting_against_plain(monkeypatch, cells):
    """Trees by histograms of merged rows, children by difference, are those of sums over rows; fitting ends as they do (F1)."""
    for name, value in (("SMALL", cells), ("SHARE", 1.0), ("LEAVES", 7), ("LEAF_ROWS", 5)):
        monkeypatch.setattr(boosting, name, value)
    rng = np.random.RandomState(8)
    x, xv = (np.vstack([rng.randint(0, 6, (3, n)), np.full(n, 4)]).astype(np.uint8) for n in (240, 90))
    y, yv = (((v[0] > 2) ^ (v[1] < 2) ^ (rng.rand(v.shape[1]) < 0.15)).astype(np.uint8) for v in (x, xv))
    for trees, rate, patience in ((3, 0.3, 40), (60, 0.5, 5)):
        got, want = boosting.boost(x, y, xv, yv, trees, rate, patience), _plain_boost(x, y, xv, yv, trees, rate, patience)
        assert np.allclose(got[0], want[0]) and got[1:] == want[1:]
    assert got[2] == got[1] + 5 < 60
    for none in (np.zeros(240, np.uint8), np.ones(240, np.uint8)):
        assert np.ptp(boosting.boost(x, none, xv, yv)[0]) == 0
    assert (boosting.boost(x[:, :0], y[:0], xv, yv)[0] < 0).all()


def test_rows_of_the_same_bins_are_merged():
    """However many columns there are, each different row is there once, with its counts (F1)."""
    rng = np.random.RandomState(9)
    x, y = rng.randint(0, 250, (60, 40)).astype(np.uint8)[:, rng.randint(0, 40, 900)], rng.randint(0, 2, 900)
    got, n, s, of = boosting._merged(x, y)
    assert (got[:, of] == x).all() and got.shape[1] == len(np.unique(x, axis=1).T) and (np.bincount(of) == n).all() and (np.bincount(of, y) == s).all()
    assert boosting._merged(x[:, :0], y[:0])[0].shape == (60, 0) and boosting._merged(x[:0], y)[1].tolist() == [900]


def test_packed_rows(spark):
    """Bins keep the order of values and put nulls last; every held-out pair comes back once, of any type of id (F1)."""
    rows = [(i, -i, i % 2, None if i % 10 == 9 else float(i % 7), None) for i in range(500)]
    df = spark.createDataFrame(rows, "query_id long, s1_id long, is_match int, y double, held double")
    train, val = df.where("query_id < 400").repartition(3), df.where("query_id >= 400")
    packed = boosting.packed(train, val, ["y", "held"])
    got = [np.frombuffer(r["y"], np.uint8) for r in packed.collect() if not r["__held"]]
    values, bins = sorted((7.0 if r[3] is None else r[3]) for r in rows[:400]), np.sort(np.concatenate(got))
    assert len(bins) == 400 and len(set(zip(values, bins.tolist()))) == len(set(values)) == len(set(bins.tolist()))
    assert sorted(tuple(r)[:2] for r in boosting.scores(packed, ["y", "held"], trees=2).collect()) == sorted((i, -i) for i in range(400, 500))


def test_ablation_of_more_than_a_task_holds(spark, monkeypatch):
    """Past the limit Spark's trees are fitted, as many as give the least loss on val before it stops falling (F1)."""
    rng = np.random.RandomState(2)
    rows = [(f"S2-{i}", f"S1-{i % 50}", int(i % 2 ^ (rng.rand() < 0.2)), float(i % 2), float(rng.rand())) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id string, s1_id string, is_match int, x double, y double")
    train, val, ids = df.where("query_id < 'S2-28'"), df.where("query_id >= 'S2-28'"), df.select("s1_id").distinct()
    stages, fitted, boosted = {"x": ["x"], "both": ["x", "y"]}, [], models.boosted
    monkeypatch.setattr(models, "boosted", lambda *a, **k: fitted.append(k) or boosted(*a, **k))
    near = models.ablation(train, val, stages, ids, val.where("is_match = 1"), trees=12, rate=0.5, patience=2).collect()
    assert not fitted
    monkeypatch.setattr(models, "TASK_BYTES", train.count() * 83)
    far = models.ablation(train, val, stages, ids, val.where("is_match = 1"), trees=12, rate=0.5, patience=2).collect()
    assert [k["trees"] for k in fitted][0] == 12 and all(0 < k["trees"] < 12 for k in fitted[1:]) and all(k["rate"] == 0.5 for k in fitted)
    assert [r[:2] for r in near] == [r[:2] for r in far] and near[0] == far[0] and abs(near[1].f - far[1].f) < 0.2


def test_categories_compute_what_they_read(spark, small, monkeypatch):
    """m2_categories asks for two similarities of names and addresses each, not for all ten and the combined one; its counts are those of all features (F7)."""
    made, fuzzy = [], features.similarity.fuzzy
    monkeypatch.setattr(features.similarity, "fuzzy", lambda a, b, *names: made.append(names) or fuzzy(a, b, *names))
    got = decision_queries.m2_categories(spark, small).collect()
    assert made == [("jaro_winkler", "fuzz_ratio")] * 2
    whole = pair_queries.main_features(spark, small).groupBy(sampling.category().alias("category"), "is_match").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole.collect()))


def test_each_pair_of_blocks_has_a_task(spark, monkeypatch):
    """Blocks are dealt by number: by hash some tasks got several and others none (F1). The results are those of brute force."""
    rng = np.random.RandomState(4)
    for name, value in (("POSTINGS_BLOCK", 150), ("QUERY_BLOCK", 60)):
        monkeypatch.setattr(retrieval, name, value)
    vectors = lambda p, n: [(f"{p}{i:03}", rng.choice(30, 5, replace=False).tolist(), rng.choice([0.5, 1.0, 2.0], 5).tolist()) for i in range(n)]
    refs, asks = vectors("r", 120), vectors("q", 40)
    r, q = spark.createDataFrame(refs, "s1_id string, t array<bigint>, w array<double>"), spark.createDataFrame(asks, "query_id string, t array<bigint>, w array<double>")
    want = []
    for i, t, w in asks:
        near = sorted((-round(sum(a * b for x, a in zip(t, w) for y, b in zip(u, v) if x == y), 6), j) for j, u, v in refs)
        want += [(i, j, -s, n) for n, (s, j) in enumerate([x for x in near if x[0] < 0][:4], 1)]
    most = retrieval.TASKS
    for tasks in (most, 5):
        monkeypatch.setattr(retrieval, "TASKS", tasks)
        assert sorted(map(tuple, retrieval.search(q, r, 4).select("query_id", "s1_id", "score", "rank").collect())) == sorted(want)
    monkeypatch.setattr(retrieval, "TASKS", most)
    monkeypatch.setattr(retrieval, "top", lambda found, *_: found)
    found = retrieval.search(q, r, 4)
    assert found.rdd.getNumPartitions() == 16 and found.select(F.spark_partition_id()).distinct().count() == 16


def test_grams_are_never_written(spark, monkeypatch):
    """Words are, and vectors of the terms that a query has: the n-grams were written with their texts, and vectors with all terms (F3, F5). Products stay the same."""
    rec = "entity_id string, name string"
    ref = spark.createDataFrame([(f"S1-{i}", f"Customer#{i:09} {'abcd' if i % 3 else 'abce'}") for i in range(90)], rec)
    query = spark.createDataFrame([("S2-1", "Supplier#000000017"), ("S2-2", "abcd 000000005"), ("S2-2", "tool"), ("S2-3", None)], rec)
    written, kept = [], writers.kept
    monkeypatch.setattr(writers, "kept", lambda df, name: written.append((name, df.dtypes)) or kept(df, name))
    got = retrieval.tfidf_top(ref, query, "name", 90)
    assert [name for name, _ in written] == ["words", "words", "postings", "query-terms"]
    assert all(kind != "array<string>" for name, types in written[2:] for _, kind in types)
    asks, rows = retrieval.tfidf_vectors(ref, query, "name")
    asked, met = ({t for r in x.collect() for t in r.t} for x in (asks, rows))
    assert met <= asked and asked
    terms = lambda name: {w: 1 + np.log(n) for w, n in Counter(g for w in name.lower().split() for g in retrieval.word_grams(w)).items()}
    refs, asks = {r[0]: terms(r[1]) for r in ref.collect()}, {"S2-1": terms("Supplier#000000017"), "S2-2": terms("abcd 000000005 tool")}
    df = Counter(t for r in refs.values() for t in r)
    idf = {t: np.log(91 / (1 + n)) + 1 for t, n in df.items() if n >= 2}
    unit = lambda v: {t: x * idf[t] / np.sqrt(sum((v[u] * idf[u]) ** 2 for u in v if u in idf)) for t, x in v.items() if t in idf}
    refs, asks = ({i: unit(v) for i, v in x.items()} for x in (refs, asks))
    want = {(q, s): sum(x * refs[s][t] for t, x in v.items() if t in refs[s]) for q, v in asks.items() for s in refs}
    got = {(r.query_id, r.s1_id): r.score for r in got.collect()}
    assert set(got) == {p for p, x in want.items() if round(x, 6) > 0.001}
    assert all(abs(x - want[p]) < 2e-6 for p, x in got.items())


def test_queries_are_looked_up_together(monkeypatch):
    """Those that two looks settle, with what each finds alone, whatever the bounds: each was looked up alone (F3, F5)."""
    rng = np.random.RandomState(7)
    rows = lambda p, n: pa.table({f"{p}_id": [f"{p}{i:05}" for i in range(n)], "t": [[*rng.choice(300, 4, replace=False), *rng.choice(np.arange(300, 306), 3, replace=False)] for _ in range(n)], "w": [[*rng.choice([0.4, 0.8, 1.0], 4), *rng.choice([0.01, 0.05], 3)] for _ in range(n)]})
    p, q = rows("s1", 4000), rows("query", 200)
    odd = pa.table({"query_id": ["none", "unknown", "frequent"], "t": [[], [9999], [300, 301]], "w": [[], [1.0], [0.5, 0.5]]}, schema=q.schema)
    q = pa.concat_tables([odd, q]).combine_chunks()
    alone, top = [], retrieval.Block.top
    monkeypatch.setattr(retrieval.Block, "top", lambda *a: alone.append(1) or top(*a))
    block = retrieval.Block(*retrieval._flat(p.sort_by("s1_id")))
    size, term, factor = retrieval._flat(q)
    last = np.cumsum(size)
    for k in (1, 5, 40):
        want = [top(block, term[e - n : e], factor[e - n : e], k, 0.001) for e, n in zip(last, size)]
        want = [(a, f"s1{c:05}", float(s)) for a, (codes, scores) in zip(q["query_id"].to_pylist(), want) for c, s in zip(codes, scores)]
        for batch, look in ((32, 50_000), (1, 50_000), (7, 600), (300, 0)):
            monkeypatch.setattr(retrieval, "BATCH", batch)
            monkeypatch.setattr(retrieval, "BATCH_LOOK", look)
            alone.clear()
            got = retrieval._block_top(k, 0.001)(q, p)
            assert sorted(zip(*(got[c].to_pylist() for c in got.column_names))) == sorted(want)
            assert len(alone) < 100 if look == 50_000 and k == 5 else len(alone) <= 203
            assert look or len(alone) == 203


def test_blend_fits_both_models_at_once(spark, small, monkeypatch):
    """The second fit begins before the first one has ended, and either gives its own part of the score (F5)."""
    meet, boosted, forest, made = threading.Barrier(2), models.boosted, models.forest, {}
    held = lambda name, fit: lambda *a, **k: made.setdefault(name, (meet.wait(60), fit(*a, **k))[1])
    monkeypatch.setattr(models, "boosted", held("boosted", boosted))
    monkeypatch.setattr(models, "forest", held("forest", forest))
    kept, seen = writers.kept, {}
    monkeypatch.setattr(writers, "kept", lambda df, name: seen.setdefault(name, kept(df, name)) if name == "features" else kept(df, name))
    got = {(r.query_id, r.s1_id): r.score for r in decision_queries.m6_blend(spark, small).collect()}
    both = models.predict(made["forest"], models.predict(made["boosted"], seen["features"].where(sampling.bucket("query_id") < 20), "p1"), "p2").collect()
    assert got and got == {(r.query_id, r.s1_id): 0.6 * r.p1 + 0.4 * r.p2 for r in both}


def test_jaro_winkler_is_linear(monkeypatch):
    """Places in reach are found by character and not one by one, with the values of the plain search (F3, F5)."""

    def plain(a, b):
        reach, used, hit = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
        for i, c in enumerate(a):
            if (j := next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)) is not None:
                used.add(j)
                hit.append(c)
        m = len(hit)
        if not m:
            return 0.0
        sim = (m / len(a) + m / len(b) + (m - sum(p != b[j] for p, j in zip(hit, sorted(used))) // 2) / m) / 3
        return sim if sim <= 0.7 else sim + next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b))) * 0.1 * (1 - sim)

    rng = np.random.RandomState(3)
    word = lambda: "".join(rng.choice(list("aab cé")[: rng.randint(1, 7)], rng.randint(1, 20)))
    for a, b in [(word(), word()) for _ in range(3000)]:
        assert features.similarity.jaro_winkler(a, b) == plain(a, b), (a, b)
    long, began = "ab" * 25_000, time.process_time()
    assert features.similarity.jaro_winkler(long, long[::-1]) > 0.8 and time.process_time() - began < 5
