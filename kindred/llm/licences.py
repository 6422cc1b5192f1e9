"""License scans in DataFrame functions only: a trained paragraph classifier, confirmed by templates.

Paragraphs are runs of lines up to one without letters or digits. Units are the lines, and of a paragraph of several lines
the sentences that cross a line's end and the whole. Candidates are those with a marker of the templates; markers are chosen so that no
unit with MIN_SHARE of a template's word pairs, or all of a name's, is without one (see markers). Each is cut into words, and its distinct
word n-grams (1 to MAX_N) meet the classifier's weights in a broadcast join, bounded by the templates. The classifier
is a sparse multinomial logistic regression over licence families and an unknown class, fitted on the driver in numpy
from the templates, variations of them, and negatives; a temperature fitted on variations set aside calibrates it. A
family of probability MIN_P or more must then be confirmed: MIN_SHARE of the word pairs of some template of the family, or all
of a short name's, are in the unit, or MOST_SHARE of the unit's pairs (MIN_PAIRS or more, one of which no other family has) are in some template. What the
classifier or the templates turn down is unknown; n_unknown counts such lines as speak of licensing (MENTION). Of hits of one family that overlap, the least that holds a whole
template stays, or else the largest. Time is linear in a text's length and in its number of hits.

Null or empty texts: nothing found. Repeated rows, null ids: a result row each. An empty table: empty result. Extra columns are
not read.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .licence_texts import NAMES, NEGATIVES, TEMPLATES

MAX_N, MIN_P, MIN_SHARE, MOST_SHARE, MIN_PAIRS, STEPS, SEED = 3, 0.5, 0.6, 0.8, 5, 300, 8
MENTION = r"(?i)licen[sc]|copyright|copyleft|spdx|warrant|redistribut|permission|public\s+domain|creative\s+commons|\bcc0?[ -](?:by|0|1)|\b[al]?gpl(?:v?\d|\b)|\bmpl\b|source\s+code\s+form|proprietary|rights\s+reserved"
UNKNOWN = "unknown"
_WORD = re.compile(r"[a-z0-9]+")
_VERSION = r"gpl(?=v?[0-9])"
PARAGRAPH, SENTENCE = r"\n(?:[^\p{L}\p{N}\n]*\n)+", r"(?<=[.!?:;])\s+(?=[^a-z0-9\s]{0,3}[A-Z])"


def _grams(text: str, most: int = MAX_N) -> list[str]:
    w = _WORD.findall(re.sub(_VERSION, "gpl ", text.lower()))
    return list(dict.fromkeys(" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)))


def _variations(text: str, rng: random.Random, n: int) -> list[str]:
    """The text, with other words around it and a few of its own gone."""
    words, out = text.split(), [text]
    other = lambda k: " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(0, k)))
    for _ in range(n):
        kept = [x for x in words if len(words) < 6 or rng.random() > 0.1]
        out.append(f"{other(6)} {' '.join(kept)} {other(6)}")
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


ABBREVIATIONS = frozenset("mit bsd gpl lgpl agpl mpl epl isc ofl cc cc0".split())


def _pairs(text: str) -> set[str]:
    return {g for g in _grams(text, 2) if " " in g}


@functools.cache
def markers() -> tuple[str, ...]:
    """Stems, at least one of which is in every unit that the templates can confirm in full.

    A confirmed unit lacks at most a share of a template's word pairs, so stems that cover more pairs than that cannot all be
    missing. They are taken greedily, by how much all templates still need them, from words of 6 letters or more and abbreviations;
    common short words mark nothing.
    """
    need: list[tuple[list[set[str]], int]] = []
    for least, given in ((1.0, NAMES), (MIN_SHARE, TEMPLATES)):
        for t in (t for ts in given.values() for t in ts):
            pairs = [{re.sub(r"(?<=\w{5})(?:e|ed|es|s|ing|ion|ions)$", "", w) for w in p.split()} for p in sorted(_pairs(t))]
            need.append((pairs, int((1 - least) * len(pairs)) + 1))
    out: list[str] = []
    weight = lambda w: 1.0 if len(w) > 5 and w not in ("without", "following") else 0.1 if w in ABBREVIATIONS else 0.0
    while need:
        gain: dict[str, float] = {}
        for pairs, n in need:
            for w in {w for p in pairs for w in p}:
                gain[w] = gain.get(w, 0.0) + min(n, sum(w in p for p in pairs)) * weight(w)
        best = min(gain, key=lambda w: (-gain[w], w), default="")
        if not gain.get(best):
            break
        out.append(best)
        left = [([p for p in pairs if best not in p], n - sum(best in p for p in pairs)) for pairs, n in need]
        need = [(pairs, n) for pairs, n in left if n > 0]
    return tuple(sorted(out))


def _trie(words: list[str]) -> str:
    """A pattern of any of the words, shared beginnings once; a word that begins another stands for both."""
    if "" in words:
        return ""
    parts = [c + _trie([w[1:] for w in words if w[0] == c]) for c in sorted({w[0] for w in words})]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


@functools.cache
def gate() -> str:
    """The pattern of a marker at the start of a word; abbreviations end there, or before a version."""
    short = "|".join(sorted(ABBREVIATIONS & set(markers())))
    return rf"(?i)(?<![a-z0-9])(?:{_trie([m for m in markers() if m not in ABBREVIATIONS])}|(?:{short})(?:v?[0-9]|(?![a-z0-9])))"


@functools.cache
def fit() -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """(classes, weights of n-grams, bias), divided by the temperature."""
    rng = random.Random(SEED)
    classes = [*TEMPLATES, UNKNOWN]
    sets: tuple[list, list] = ([], [])
    for y, name in enumerate(TEMPLATES):
        for text in [*TEMPLATES[name], *NAMES.get(name, [])]:
            for i, v in enumerate(_variations(text, rng, 12)):
                sets[i % 4 == 3].append((v, y))
    unknown = len(classes) - 1
    holders: dict[str, set[str]] = {}
    for name, ts in TEMPLATES.items():
        for g in {g for t in ts for g in _pairs(t)}:
            holders.setdefault(g, set()).add(name)
    for y, name in enumerate(TEMPLATES):  # parts of long templates; those that several families have tell nothing
        for words in (t.split() for t in TEMPLATES[name] if len(t.split()) > 12):
            for i in range(12):
                k = rng.randint(6, 14)
                at = rng.randint(0, max(0, len(words) - k))
                part = " ".join(words[at : at + k])
                sets[i % 4 == 3].append((part, y if any(holders[g] == {name} for g in _pairs(part)) else unknown))
    names = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)).title() for _ in range(24)]
    made = [f"{a} under the {b} License{c}" for b in names for a, c in (("Licensed", ", Version 2.0."), ("Released", "."))]
    for text in [*NEGATIVES, *made]:
        for i, v in enumerate(_variations(text, rng, 3)):
            sets[i % 4 == 3].append((v, unknown))
    vocabulary = {g: i for i, g in enumerate(sorted({g for v, _ in sets[0] for g in _grams(v)} & {g for t in [*NEGATIVES, *made, *(x for d in (TEMPLATES, NAMES) for ts in d.values() for x in ts)] for g in _grams(t)}))}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary)))
        for i, (v, _) in enumerate(rows):
            x[i, [vocabulary[g] for g in _grams(v) if g in vocabulary]] = 1
        return x, np.array([y for _, y in rows])

    x, y = matrix(sets[0])
    target = np.eye(len(classes))[y]
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    for _ in range(STEPS):
        g = _softmax(x @ w + b) - target
        w -= 0.5 * (x.T @ g / len(x) * 4 + 2e-4 * w)
        b -= 0.5 * g.mean(axis=0)
    xh, yh = matrix(sets[1])
    z = xh @ w + b
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    t = min(loss, key=lambda k: (loss[k], k))
    return classes, {g: w[i] / t for g, i in vocabulary.items()}, b / t


def _cut(text: Column, sep: str, begin: Column) -> Column:
    """Parts of text between matches of sep that hold a marker, with their starts (code points, from begin on)."""
    parts = F.arrays_zip(F.split(text, sep, -1).alias("p"), F.regexp_extract_all(text, F.lit(sep), F.lit(0)).alias("s"))
    size = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["s"]), F.lit(0))
    placed = common.let(parts, lambda z: F.zip_with(z, common.befores(F.transform(z, size), lambda a, x: a + x), lambda x, at: F.struct((begin + at).alias("start"), x["p"].alias("line"))))
    return F.filter(placed, lambda x: x["line"].rlike(gate()))


def paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Candidates of the rows (with columns __row and text): __row, start, end (code points), line."""
    text = F.col(text_col)
    whole = docs.where(text.rlike(gate())).select("__row", F.explode(_cut(text, PARAGRAPH, F.lit(0))).alias("p")).select("__row", F.col("p.start").alias("at"), F.col("p.line").alias("part"))
    wide = F.filter(_cut(F.col("part"), SENTENCE, F.col("at")), lambda x: x["line"].contains("\n") & (x["line"] != F.col("part")))
    one = F.filter(F.array(F.struct(F.col("at").alias("start"), F.col("part").alias("line"))), lambda x: x["line"].contains("\n"))
    all_of = F.concat(_cut(F.col("part"), "\n", F.col("at")), wide, one)  # no unit is there twice
    found = whole.select("__row", F.explode(all_of).alias("p"))
    return found.select("__row", "p.start", (F.col("p.start") + F.length("p.line")).alias("end"), "p.line")


def _ngrams(words, n: int):
    return F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(__row, start, end, family, p, single, full) of each candidate; family is `unknown` where the classifier or templates turn it down.

    single: it is one line and speaks of licensing; full: it holds a template of the family.
    """
    spark = docs.sparkSession
    classes, weights, bias = fit()
    of: dict[str, list[int]] = {}
    known: dict[str, list[tuple[int, int, float]]] = {}
    holders: dict[str, set[str]] = {}
    for least, given in ((MIN_SHARE, TEMPLATES), (1.0, NAMES)):
        for k, t in ((k, t) for k, ts in given.items() for t in ts):
            pairs = sorted(_pairs(t))
            at = sum(map(len, known.values()))
            known.setdefault(k, []).append((at, len(pairs), least))
            for g in pairs:
                of.setdefault(g, []).append(at)
                holders.setdefault(g, set()).add(k)
    families = {k: -1 - i for i, k in enumerate(known)}  # a pair that one family alone has, carries its number
    for g, who in holders.items():
        if len(who) == 1:
            of[g].append(families[min(who)])
    table = F.broadcast(spark.createDataFrame([(g, w.tolist(), of.get(g, [])) for g, w in weights.items()], "gram string, w array<double>, t array<int>"))
    templates = F.broadcast(spark.createDataFrame([(k, families[k], v) for k, v in known.items()], "family string, own int, templates array<struct<t:int,size:int,least:double>>"))
    words = F.regexp_extract_all(F.regexp_replace(F.lower("line"), _VERSION, "gpl "), F.lit("[a-z0-9]+"), F.lit(0))
    cand = paragraphs(docs, text_col).withColumn("words", words).withColumn("n", F.size("words")).withColumn("single", ~F.col("line").contains("\n") & F.col("line").rlike(MENTION))
    grams = F.concat(*(F.when(F.col("n") >= n, _ngrams(F.col("words"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, MAX_N + 1)))
    cand = cand.withColumn("n_pairs", F.when(F.col("n") >= 2, F.size(F.array_distinct(_ngrams(F.col("words"), 2)))).otherwise(0))
    one = cand.select("__row", "start", "end", "single", "n_pairs", F.explode_outer(F.array_distinct(grams)).alias("gram")).join(table, "gram", "left")
    key = ["__row", "start", "end", "single", "n_pairs"]
    sums = one.groupBy(*key).agg(F.flatten(F.collect_list("t")).alias("hits"), *(F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"z{i}") for i in range(len(classes))))
    z = F.array(*(F.round(F.col(f"z{i}") + float(bias[i]), 9) for i in range(len(classes))))
    best = sums.select(*key, "hits", z.alias("z")).withColumn("top", F.array_max("z"))
    judged = best.select(*key, "hits", F.element_at(F.array(*map(F.lit, classes)), F.array_position("z", F.col("top")).cast("int")).alias("family"), (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("p"))
    met = lambda x: F.size(F.filter("hits", lambda h: h == x["t"]))
    full = F.coalesce(F.exists("templates", lambda x: met(x) >= x["least"] * x["size"]), F.lit(False))
    inside = F.coalesce((F.col("n_pairs") >= MIN_PAIRS) & F.array_contains("hits", F.col("own")) & F.exists("templates", lambda x: met(x) >= MOST_SHARE * F.col("n_pairs")), F.lit(False))
    confirmed = judged.join(templates, "family", "left").withColumn("full", full).withColumn("inside", inside)
    return confirmed.select("__row", "start", "end", F.when((F.col("p") >= MIN_P) & (F.col("full") | F.col("inside")), F.col("family")).otherwise(UNKNOWN).alias("family"), "p", "single", "full")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_found, licences (sorted, comma-joined), spans (family:start:end by start), n_unknown."""
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    found = common.cut(find(src, "__text"), "licences")
    # units nest or are apart, but for sentences and lines, which may cross; by start, and the larger first, those within another come after it
    order = (F.col("start"), F.col("end").desc())
    after = Window.partitionBy("__row", "family").orderBy(F.col("start").desc(), "end").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("__row", "family").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = found.where(F.col("family") != UNKNOWN)
    known = known.withColumn("e", F.min(F.when(F.col("full"), F.col("end"))).over(after)).where("e is null or e > end")
    known = known.withColumn("e", F.max("end").over(ahead)).where("e is null or e < end")
    others = found.where((F.col("family") == UNKNOWN) & F.col("single"))
    both = known.select("__row", "start", "end", "family").unionByName(others.select("__row", "start", "end", "family"))
    is_known = F.col("family") != UNKNOWN
    reach = Window.partitionBy("__row").orderBy(*order, is_known.desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("e", F.max(F.when(is_known, F.col("end"))).over(reach))
    by = both.groupBy("__row").agg(
        F.array_sort(F.collect_set(F.when(is_known, F.col("family")))).alias("names"),
        F.array_sort(F.collect_list(F.when(is_known, F.struct("start", "end", "family")))).alias("at"),
        F.count_if(~is_known & (F.col("e").isNull() | (F.col("e") < F.col("end")))).alias("n_unknown"),
    )
    none = F.coalesce(F.size("at"), F.lit(0))
    return (
        src.select("__id", "__row").join(by, "__row", "left")
        .select(
            F.col("__id").alias(id_col),
            F.when(F.col("at").isNull(), 0).otherwise(none).cast("long").alias("n_found"),
            F.coalesce(F.array_join("names", ","), F.lit("")).alias("licences"),
            F.coalesce(F.array_join(F.transform("at", lambda s: F.concat_ws(":", s["family"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit("")).alias("spans"),
            F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
        )
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_found, licences, spans, n_unknown over whole documents."""
    return scan(common.table(spark, sf_dir, "documents"))
