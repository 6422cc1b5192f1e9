import random
import unicodedata
from collections import Counter

import pytest
from kindred.functions import phonetics, similarity, tables, text
from kindred.operators import veto
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "expected"), [("A\tB", "ab"), ("A, B!", "a b"), (None, ""), ("", ""), ("Straße", "strasse"), ("a​b", "ab"), ("  x   y ", "x y"), ("फर्स्ट, ई!", "फर्स्ट ई")])
def test_normalize(spark, given, expected):
    assert one(spark, text.normalize(F.lit(given))) == expected
    assert text.normal(given) == expected


def test_normalize_column_is_full(spark):
    """The column against the plain function: ligatures, full width, superscripts, fractions, final sigma, numerals, marks, and what stays in the JVM."""
    given = ["ﬁne Ｆｕｌｌ", "ΟΔΟΣ", "½ cup", "x²", "Ⅳ", "e\u0301te\u0301", "हिन्दी नाम", "Straße ÀÉ", "漢字 かな 한글", "İstanbul", "a\u200bb\nc", "—“q”… €5", "ǅ ŉ ſ K", "Ж ё Ё", None, "", " \u00a0 "]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", text.normalize("t").alias("n")).collect()}
    assert got == {i: text.normal(t) for i, t in enumerate(given)}


def test_safe_characters_need_no_arrow(spark):
    safe = [chr(c) for c in range(0xD7A4) if text._safe(chr(c))]
    df = spark.createDataFrame([(c,) for c in safe], "c string")
    bad = [r for r in df.select("c", text.normalize(F.concat(F.lit("a"), "c", F.lit("B"))).alias("n")).collect() if r.n != text.normal(f"a{r.c}B")]
    assert not bad


def test_normalize_full_composes():
    assert text.normal("ﬁ Ⅳ") == "fi iv"


def test_latin():
    assert text.latin("café") == "cafe"
    assert text.latin("प्रा") == "pra"
    assert text.latin("१२") == "12"
    assert text.latin("ऍ") == "ऍ" and text.latin("ऍ", unmapped="drop") == ""
    assert text.latin("é", inner=False) == "e"


def test_forms_split_by_script(spark):
    df = spark.createDataFrame([("1", "Café Ltd", "x"), ("2", "फर्स्ट", None), ("3", "NA", "")], "entity_id string, n string, a string")
    got = {r.entity_id: r for r in text.with_forms(df, {"name": "n", "addr": "a"}).collect()}
    assert got["1"].name_transliterated == "cafe ltd" and got["2"].name_transliterated == text.latin("फर्स्ट") and got["3"].name_normalized == "na" and got["2"].addr_normalized == ""


def test_clean_of_other_scripts(spark):
    df = spark.createDataFrame([("1", "फर्स्ट pvt ltd"), ("2", "Café, Inc."), ("3", "क ऍ"), ("4", None)], "entity_id string, n string")
    keep, drop = ({r.entity_id: r.x for r in text.with_clean(df, {"x": "n"}, u).collect()} for u in ("keep", "drop"))
    assert keep["1"] == text.latin(text.normal("फर्स्ट"), False) + " private limited" and keep["2"] == "cafe incorporated" and keep["4"] == ""
    assert keep["3"] == "k ऍ" and drop["3"] == "k"


def test_expand_in_order(spark):
    assert one(spark, text.expand(F.lit("prime pvt ltd co st"))) == "prime private limited company street"
    assert one(spark, text.expand(F.lit("प्रा लि"), indic=True)) == "private limited"


@pytest.mark.parametrize(("given", "expected"), [("", "Empty"), ("123 !", "Numeric/Symbol"), ("abc", "Latin"), ("абв", "Cyrillic"), ("कखग", "Devanagari"), ("abcдеж", "Mixed"), ("abcdefghж", "Latin"), ("אב", "Hebrew"), ("ሀ", "Other")])
def test_script(spark, given, expected):
    assert one(spark, text.script(F.lit(given))) == expected


def test_script_counts_once(spark):
    """Against a plain count of letters, at and around 7 in 10; and no pattern goes over a text more than once (F2)."""
    assert str(text.script(F.col("t"))).count("regexp_replace") <= 12

    def plain(s):
        letters = [c for c in s if unicodedata.category(c)[0] == "L"]
        which = Counter(next((k for k, r in tables.SCRIPTS.items() if any(a <= ord(c) <= b for a, b in r)), "Other") for c in letters)
        if not letters:
            return "Numeric/Symbol" if s else "Empty"
        return next((k for k, n in which.items() if n / len(letters) >= 0.7), "Mixed")

    kinds = ("a", "é", "ж", "क", "ك", "漢", "λ", "ש", "ሀ", "1", " ", "×", "𐐀", "ª", "्")
    rng = random.Random(1)
    given = ["", "1", *("a" * n + "ж" * (10 - n) for n in range(11)), *("ሀ" * n + "é" * (10 - n) for n in range(11)), *("".join(rng.choices(rng.sample(kinds, 3), (8, 2, 1), k=rng.randint(1, 12))) for _ in range(300))]
    got = spark.createDataFrame([(s,) for s in given], "t string").select("t", text.script("t").alias("s")).collect()
    assert {r.t: r.s for r in got} == {s: plain(s) for s in given}


def test_serialize(spark):
    f = lambda n, a, c, s="compact": one(spark, text.serialize(text.clean(F.lit(n)), text.clean(F.lit(a)), text.country(F.lit(c)), s))
    assert f("", "", "") == "[NAME] unknown"
    assert f("Prime Money Pvt Ltd", "", "US") == "[NAME] prime money private limited [CTRY] US"
    assert f("", "", "", "ditto") == ""
    assert f("A", "B", "us", "ditto") == "[COL] name [VAL] a [COL] address [VAL] b [COL] country [VAL] US"


@pytest.mark.parametrize(("word", "sound", "meta", "bones"), [("Robert", "R163", "RBRT", "RBRT"), ("sharma", "S650", "XRM", "SRM"), ("reliance", "R452", "RLNS", "RLNC"), ("state", "S330", "STT", "STT"), ("sbi", "S100", "SB", "SB"), ("123", "", "", "")])
def test_phonetics(spark, word, sound, meta, bones):
    assert one(spark, phonetics.soundex(F.lit(word))) == sound
    assert phonetics.metaphone(word) == meta
    assert one(spark, phonetics.skeleton(F.lit(word))) == bones


@pytest.mark.parametrize(("word", "expected"), [("Knight", "NT"), ("write", "RT"), ("Xavier", "SFR"), ("bomb", "BM"), ("edge", "EJ"), ("thumb", "0M"), ("nation", "NXN"), ("accent", "AKSNT"), ("wow", "WW"), ("box", "BKS"), ("ahoy", "AHJ"), ("philosophers", "FLSFRS")])
def test_metaphone(word, expected):
    assert phonetics.metaphone(word) == expected


def test_phonetic_keys(spark):
    df = spark.createDataFrame([("1", "Pvt Reliance"), ("2", "x 1"), ("3", "Sharma & Co")], "entity_id string, n string")
    got = {(r.entity_id, r.key) for r in phonetics.with_keys(df, "n").collect()}
    assert got == {("1", "M:PFT"), ("1", "S:P300"), ("1", "C:PVT"), ("1", "MS:RLNS"), ("3", "M:XRM"), ("3", "S:S650"), ("3", "C:SRM")}


def test_numbers(spark):
    assert one(spark, text.numbers(F.lit("12 a 12 b3 400"))) == ["12", "400"]
    assert one(spark, text.pins(F.lit("12345 123456 1234567"))) == ["12345", "123456"]
    assert one(spark, text.street_numbers(F.lit("100 Main St, NY 10001"))) == ["100"]
    assert one(spark, text.street_numbers(F.lit("10001"))) == ["10001"]


def test_state(spark):
    assert one(spark, text.state(F.lit("Tulsa, ok to TX"))) == "TX"
    assert one(spark, text.state(F.lit("x DC"))) == "DC" and one(spark, text.state(F.lit("x DC"), False)) is None


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("17560 Ellis Road, Tahlequah, OK 74464", "18200 Ellis Road, Tahlequah, OK 74464", False),
        ("Google LLC, Mountain View, CA 94043", "Google LLC, Sunnyvale, CA 94086", True),
        ("Amazon HQ, Seattle, WA", "Amazon Warehouse, Dallas, TX", True),
        ("Microsoft Corp, Redmond, WA 98052", "Microsoft Corporation, Redmond, WA 98052", False),
        ("100 Main St, NY 10001", "200 Main St, NY 10001", True),
    ],
)
def test_veto(spark, a, b, expected):
    assert one(spark, veto.veto(F.lit(a), F.lit(b), F.lit("US"), F.lit("US"))) is expected


def test_veto_countries(spark):
    g = lambda x, y: one(spark, veto.geographic_conflict(F.lit(x), F.lit(y), F.lit("TX"), F.lit("CA")))
    assert g("IN", "US") and g("", "IN") and not g("IN", "") and g("", "")


def test_acronym_and_distinct(spark):
    assert one(spark, text.acronym(F.lit("SBI"), F.lit("State Bank of India"))) == 1
    assert one(spark, text.acronym(F.lit("S"), F.lit("State"))) == 0
    assert one(spark, text.distinct_names(F.lit("alpha inc"), F.lit("beta inc"))) == 1
    assert one(spark, text.distinct_names(F.lit("inc"), F.lit("beta"))) == 0


def lcs_plain(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert similarity.lcs(a, b) == lcs_plain(a, b)
        n = len(a) + len(b)
        assert similarity.ratio(a, b) == (2 * lcs_plain(a, b) / n if n else 1.0)
        if a and b and len(a) != len(b):
            short, long = sorted((a, b), key=len)
            parts = {long[i:j] for i in range(len(long)) for j in range(i + 1, len(long) + 1) if j - i <= len(short)}
            assert similarity.partial_ratio(a, b) <= max(similarity.ratio(short, p) for p in parts) + 1e-12 and similarity.partial_ratio(a, b) >= similarity.ratio(short, long[: len(short)]) - 1e-12


def test_known_similarities():
    assert round(similarity.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(similarity.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert similarity.token_sort("b a", "a b") == 1.0
    assert similarity.token_set("a b", "a b c") == 1.0
    assert similarity.token_set("", "a") == 0.0
    assert similarity.partial_ratio("abc", "xxabcxx") == 1.0


def test_columns_of_similarity(spark):
    df = spark.createDataFrame([("", ""), ("a b", ""), ("a b", "a b"), ("a a b", "b c")], "p string, q string")
    p, q = F.col("p"), F.col("q")
    rows = df.select(similarity.levenshtein(p, q), similarity.length_ratio(p, q), similarity.token_jaccard(p, q), similarity.token_overlap(p, q), similarity.token_diff(p, q), similarity.fuzzy(p, q)["token_set"]).collect()
    assert [tuple(r) for r in rows][:3] == [(0.0, 0.0, 0.0, 0, 0, 0.0), (0.0, 0.0, 0.0, 0, 2, 0.0), (1.0, 1.0, 1.0, 2, 0, 1.0)]
    assert tuple(rows[3])[2:5] == (1 / 3, 1, 0)


def test_partial_ratio_of_all_parts():
    """Against every window tried on its own; beginnings and ends come of one pass each (F6)."""
    assert similarity.lcs_starts("abcd", "xbxd") == [similarity.lcs("abcd", "xbxd"[:n]) for n in range(1, 5)]
    rng = random.Random(5)
    for _ in range(2000):
        a, b = sorted(("".join(rng.choices("abc é", k=rng.randint(1, 9))) for _ in range(2)), key=len)
        m, n = len(a), len(b)
        parts = [b[i : i + m] for i in range(n - m + 1)] + [b[:i] for i in range(1, m)] + [b[i:] for i in range(n - m + 1, n)]
        best = max(similarity.ratio(a, p) for p in parts)
        if m == n:
            best = max([best, *(similarity.ratio(b, p) for i in range(1, m) for p in (a[:i], a[i:]))])
        assert similarity.partial_ratio(a, b) == similarity.partial_ratio(b, a) == best
