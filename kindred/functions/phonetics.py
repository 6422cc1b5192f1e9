"""Phonetic codes of words. Soundex and the consonant skeleton are expressions; the metaphone is an Arrow UDF over distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables, text


def letters(w: Column) -> Column:
    return F.regexp_replace(F.upper(w), "[^A-Z]", "")


def soundex(w: Column) -> Column:
    """Empty for a word without letters."""
    x = letters(w)
    return F.when(x == "", "").otherwise(F.soundex(x))


def skeleton(w: Column) -> Column:
    """First letter and the consonants after it, five in all."""
    x = letters(w)
    return F.substring(F.concat(F.substring(x, 1, 1), F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), "[AEIOUYHW]", "")), 1, 5)


# The metaphone as rewriting rules, tried in order at each place; each takes what it matches and writes what stands beside it.
# (?<=..) looks at the letter before, (?=..) at those that follow.
_RULES = [
    (r"(?<=(?P<same>[ABD-Z]))(?P=same)", ""),
    (r"(?<!.)[AEIOU]", None),
    (r"[AEIOU]", ""),
    (r"(?<=M)B$", ""),
    (r"B", "B"),
    (r"C(?=[IEY])", "S"),
    (r"CH", "X"),
    (r"C", "K"),
    (r"DG(?=[EIY])", "J"),
    (r"D", "T"),
    (r"[FV]", "F"),
    (r"GH", ""),
    (r"G(?=[EIY])", "J"),
    (r"G", "K"),
    (r"(?:(?<!.)|(?<=[AEIOU]))H(?=[AEIOU]|$)", "H"),
    (r"H", ""),
    (r"[JY]", "J"),
    (r"[KQ]", "K"),
    (r"PH", "F"),
    (r"SH", "X"),
    (r"[SZ]", "S"),
    (r"TH", "0"),
    (r"TI(?=[AO])", "X"),
    (r"W(?=[AEIOU]|$)", "W"),
    (r"W", ""),
    (r"X", "KS"),
    (r"[LMNPRT]", None),
]
_RULE = re.compile("|".join(f"(?P<r{i}>{p})" for i, (p, _) in enumerate(_RULES)))


def metaphone(word: str | None) -> str:
    """Simplified Metaphone of up to six signs."""
    w = re.sub("[^A-Z]", "", (word or "").upper())
    w = re.sub("^(?:K(?=N)|G(?=N)|P(?=[NS])|W(?=R))", "", w) if not w.startswith("X") else "S" + w[1:]

    def write(m: re.Match) -> str:
        to = _RULES[int(m.lastgroup[1:])][1]
        return m[0] if to is None else to

    return _RULE.sub(write, w)[:6]


@F.pandas_udf(T.StringType())
def metaphone_udf(s: pd.Series) -> pd.Series:
    known = {w: metaphone(w) for w in s.unique()}
    return s.map(known)


def token_codes(df: DataFrame, column: str) -> DataFrame:
    """(word, metaphone) of the distinct words of two letters or more in a column."""
    w = df.select(F.explode(text.words(text.text(column))).alias("word")).where(F.length("word") >= 2).distinct()
    return w.withColumn("metaphone", metaphone_udf("word"))


@F.pandas_udf(T.StringType())
def fingerprint_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: " ".join(k for k in (metaphone(w) for w in (x or "").split() if len(w) >= 2) if k))


@F.pandas_udf(T.ArrayType(T.StringType()))
def metaphones_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: sorted({k for k in (metaphone(w) for w in (x or "").split() if len(w) >= 2) if k}))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of codes; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def with_keys(df: DataFrame, column: str, key: str = "key") -> DataFrame:
    """df, a row for each blocking key: M:, S: and C: of the first word, MS: of the first telling one if another."""
    tokens = F.filter(F.transform(text.words(text.text(column)), letters), lambda w: F.length(w) >= 2)
    stops = F.array(*map(F.lit, tables.PHONETIC_STOPS))
    first = F.try_element_at(tokens, F.lit(1))
    telling = F.try_element_at(F.filter(tokens, lambda w: ~F.array_contains(stops, w)), F.lit(1))
    x = df.withColumn("__first", first).withColumn("__telling", F.when(telling != first, telling))
    x = x.withColumn("__m", metaphone_udf("__first")).withColumn("__t", metaphone_udf("__telling"))
    tagged = [("M:", F.col("__m")), ("S:", soundex(F.col("__first"))), ("C:", skeleton(F.col("__first"))), ("MS:", F.when(F.col("__telling").isNotNull(), F.col("__t")))]
    keys = F.array_compact(F.array(*(F.when(v != "", F.concat(F.lit(t), v)) for t, v in tagged)))
    return x.where("__first is not null").withColumn(key, F.explode(keys)).drop("__first", "__telling", "__m", "__t")
