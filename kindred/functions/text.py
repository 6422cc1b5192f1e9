"""Text normalisation and string scalars, as expressions that stay in the JVM wherever Spark can say them.

Null is as the empty string throughout; results are never null unless said.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

_KEPT = r"\x{900}-\x{97F}\x{980}-\x{9FF}\x{600}-\x{6FF}\x{400}-\x{4FF}\x{4E00}-\x{9FFF}"
INVISIBLE = r"[\x{200B}-\x{200F}\x{FEFF}\x00-\x1F\x7F-\x{9F}]"
OTHER = rf"[^\p{{L}}\p{{N}}_\s\p{{Z}}{_KEPT}]"
SPACE = r"[\s\p{Z}]+"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column | str) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(text(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def normalize(c: Column | str) -> Column:
    """In full (see normal): invisible and control characters deleted (line feeds too), compatibility composition, case folding,
    other than word characters to spaces.

    Texts of characters that composition leaves alone and whose folding is their lower case (SAFE; most texts) stay in the JVM; Arrow carries
    the others only, and nulls in place of these.
    """
    shown = F.regexp_replace(text(c), INVISIBLE, "")
    here = squeeze(F.regexp_replace(F.replace(F.lower(shown), F.lit("ß"), F.lit("ss")), OTHER, " "))
    return F.coalesce(_normalize_full(F.when(~text(c).rlike(SAFE), text(c))), here)


def _safe(c: str) -> bool:
    """Whether a character alone, and before or after any other, is composed to itself and folded by lower case (ß aside)."""
    plain = unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)
    return plain and unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cn" and (c == "ß" or (c.lower() == c.casefold() and len(c.lower()) == 1)) and c not in "Σσς"


def _safe_pattern() -> str:
    """Runs of safe characters in the scripts that are common: Latin, Greek, Cyrillic, punctuation, currency, kana, Han, Hangul syllables."""
    runs: list[list[int]] = []
    for low, high in ((0, 0x24F), (0x370, 0x52F), (0x2010, 0x2027), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3)):
        for code in range(low, high + 1):
            if _safe(chr(code)):
                if runs and runs[-1][1] == code - 1:
                    runs[-1][1] = code
                else:
                    runs.append([code, code])
    return "^[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]*$"


SAFE = _safe_pattern()
_PY_INVISIBLE = re.compile("[\u200b-\u200f\ufeff\x00-\x1f\x7f-\x9f]")
_PY_OTHER = re.compile("[^\\w\\s\u0900-\u097f\u0980-\u09ff\u0600-\u06ff\u0400-\u04ff\u4e00-\u9fff]")


def normal(s: str | None) -> str:
    """One text in full: compatibility composition and case folding included."""
    s = unicodedata.normalize("NFKC", _PY_INVISIBLE.sub("", s or "")).casefold()
    return " ".join(_PY_OTHER.sub(" ", s).split())


def latin(s: str, inner: bool = True, unmapped: str = "keep") -> str:
    """One normalised text in Latin letters.

    inner: the main variant, which drops all combining marks after compatibility decomposition; else canonical
    decomposition and nonspacing marks only. unmapped: Devanagari without a counterpart, keep or drop.
    """
    if s.isascii():
        return s
    s = "".join(tables.DEVANAGARI.get(c, c if unmapped == "keep" else "") if "\u0900" <= c <= "\u097f" else c for c in s)
    if inner:
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    else:
        s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    return " ".join(s.split())


@F.pandas_udf(T.StringType())
def _normalize_full(s: pd.Series) -> pd.Series:
    return s.map(normal, na_action="ignore")


def _latin_full(column: Column | str, inner: bool = True, unmapped: str = "keep") -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: latin(x, inner, unmapped))

    return run(column)


def transliterate(c: Column | str) -> Column:
    """Latin form of normalised text without Devanagari, in the JVM: accents go, all else stays."""
    source, target = tables.accents()
    return squeeze(F.regexp_replace(F.translate(normalize(c), source, target), r"\p{Mn}", ""))


#: What the JVM expressions treat exactly as the full ones: ASCII, Latin-1 and Latin Extended-A letters that decompose.
_PLAIN = r"^[\x00-\x7F\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*$"


def _by_plainness(df: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    plain = F.lit(True)
    for c in columns.values():
        plain = plain & text(c).rlike(_PLAIN)
    return df.where(plain), df.where(~plain)


def with_clean(df: DataFrame, columns: dict[str, str], unmapped: str = "keep") -> DataFrame:
    """df with each new: column cleaned for the later variants (normalised, Latin, expanded), in full; rows are split as in with_forms.

    unmapped: Devanagari without a counterpart, keep (sieve) or drop (late).
    """
    fast, slow = _by_plainness(df, columns)
    for new, c in columns.items():
        fast = fast.withColumn(new, clean(c))
        slow = slow.withColumn(new, expand(_latin_full(_normalize_full(text(c)), False, unmapped)))
    return fast.unionByName(slow)


def with_forms(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with <new>_normalized and <new>_transliterated for each new: column, in full.

    Rows of plain characters stay in the JVM; only the others, split off by a filter so that none is computed twice, go
    through Arrow batches.
    """
    fast, slow = _by_plainness(df, columns)
    for new, c in columns.items():
        fast = fast.withColumn(f"{new}_normalized", normalize(c)).withColumn(f"{new}_transliterated", transliterate(c))
        slow = slow.withColumn(f"{new}_normalized", _normalize_full(text(c)))
        slow = slow.withColumn(f"{new}_transliterated", _latin_full(f"{new}_normalized"))
    return fast.unionByName(slow)


def expand(c: Column, indic: bool = False) -> Column:
    """Whole-word expansions in their order."""
    for word, full in [*tables.EXPANSIONS, *(tables.EXPANSIONS_INDIC if indic else [])]:
        c = F.regexp_replace(c, rf"(?U)\b{word}\b", full)
    return squeeze(c)


def clean(c: Column | str) -> Column:
    """Normalised, Latin, expanded, for text without Devanagari; see with_clean."""
    return expand(transliterate(c))


def country(c: Column | str) -> Column:
    return F.upper(strip(c))


def join_fields(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *parts))


def words(c: Column) -> Column:
    """Tokens between white space, none empty."""
    return F.filter(F.split(c, SPACE), lambda x: x != "")


def terms(c: Column) -> Column:
    """Runs of letters, numbers and underscores (Python's word characters)."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def _within(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def script(c: Column | str) -> Column:
    """Empty, Numeric/Symbol, the script of 7 in 10 letters or more, Other for letters of none of them, or Mixed.

    Scripts share no letter and 7 in 10 are most of them, so the first that has as many is the only one and those after it are not
    counted. ASCII letters are counted apart; what goes through the scripts' patterns are the other letters, most often few.
    """
    only = lambda x, outside: F.regexp_replace(x, outside, "")
    parts = F.struct(F.length(only(text(c), "[^A-Za-z]+")).alias("plain"), only(only(text(c), r"[\x00-\x7F]+"), r"\P{L}+").alias("more"))

    def of(x: Column) -> Column:
        total = x["plain"] + F.length(x["more"])
        counts = {name: F.length(x["more"]) - F.length(only(x["more"], f"[{_within(r)}]+")) for name, r in tables.SCRIPTS.items()}
        counts["Latin"] += x["plain"]
        counts["Other"] = F.length(only(x["more"], f"[{''.join(map(_within, tables.SCRIPTS.values()))}]+"))
        found = F.lit("Mixed")
        for name, n in reversed(counts.items()):
            found = F.when(n / total >= tables.DOMINANT, name).otherwise(found)
        return F.when(total == 0, "Numeric/Symbol").otherwise(found)

    return F.when(text(c) == "", "Empty").otherwise(F.transform(F.array(parts), of)[0])


def serialize(name: Column, address: Column, ctry: Column, style: str = "compact") -> Column:
    """One string of cleaned fields with tags; fields that are empty are left out."""
    if style == "ditto":
        parts = [F.when(x != "", F.concat(F.lit(f"[COL] {t} [VAL] "), x)) for t, x in (("name", name), ("address", address), ("country", ctry))]
        return F.concat_ws(" ", *parts)
    parts = [F.when(x != "", F.concat(F.lit(f"[{t}] "), x)) for t, x in (("NAME", name), ("ADDR", address), ("CTRY", ctry))]
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", "[NAME] unknown").otherwise(joined)


def state(c: Column | str, district: bool = True) -> Column:
    """Last US state code in an address, or null."""
    known = F.array(*map(F.lit, tables.STATES + [tables.DISTRICT] * district))
    return F.try_element_at(F.filter(F.regexp_extract_all(F.upper(text(c)), F.lit(r"(?U)\b([A-Z]{2})\b"), F.lit(1)), lambda x: F.array_contains(known, x)), F.lit(-1))


def numbers(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(?U)\b(\d+)\b"), F.lit(1)))


def pins(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(?U)\b(\d{5,6})\b"), F.lit(1)))


def street_numbers(c: Column | str) -> Column:
    """Numbers that are no postal codes, or all numbers if none is left."""
    rest = F.array_except(numbers(c), pins(c))
    return F.when(F.size(rest) > 0, rest).otherwise(numbers(c))


def _generic(x: Column) -> Column:
    return F.array_contains(F.array(*map(F.lit, tables.GENERIC)), x)


def acronym(query: Column, name: Column) -> Column:
    """1 if the query's letters, 2 to 6 of them, begin the initials of the name's telling words."""
    q = F.regexp_replace(F.upper(text(query)), "[^A-Z]", "")
    telling = F.filter(F.regexp_extract_all(F.upper(text(name)), F.lit("([A-Z]+)"), F.lit(1)), lambda w: ~_generic(F.lower(w)))
    initials = F.array_join(F.transform(telling, lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.length(q).between(2, 6) & initials.startswith(q), 1).otherwise(0)


def distinct_names(a: Column, b: Column) -> Column:
    """1 if both names have telling words and share none."""
    x, y = (F.filter(words(text(c)), lambda w: ~_generic(w) & (F.length(w) > 1)) for c in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y), 1).otherwise(0)


def once(c: Column, f) -> Column:
    """f of c as an array, with c computed once a row: a lambda's own argument is not expanded into its body."""
    return F.flatten(F.transform(F.array(c), f))


def gram_ids(c: Column, n: int = 3) -> Column:
    """31-bit ids of a text's character n-grams (a shorter text is one, an empty one none), from md5 so that SQL can say it too."""

    def grams(x: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: gram_id(F.substring(x, i, n)))
        return F.when(x == "", F.array().cast("array<bigint>")).when(F.length(x) < n, F.array(gram_id(x))).otherwise(some)

    return once(c, grams)


def gram_id(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def padded_gram_ids(c: Column, most: int = 32) -> Column:
    """Ids 1..65535 of the trigrams of <text>, the first `most`, padded with 0."""
    ids = F.transform(gram_ids(F.concat(F.lit("<"), c, F.lit(">"))), lambda x: x % 65535 + 1)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), most)), 1, most)
