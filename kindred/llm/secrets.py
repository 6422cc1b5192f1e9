"""Secret scans in DataFrame functions only: fixed patterns, and a randomness test battery under false-discovery control.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped afterwards:
  assign  a keyword, a separator and a value of 6 characters or more
  access  AKIA and a run of capitals and digits, 20 characters or more in all
  hex     a run of hexadecimal digits, 24 characters or more

The battery adds kind random: runs of 20 or more characters of [A-Za-z0-9+/_=-] that overlap no base span. The encoding
inferred from a token's characters (hex 16, base32 32, base64 64 symbols) says what a uniform alphabet is. The null
hypothesis is "this is writing": symbols as uneven as in words (UNEVEN) and character classes that change at CHANGE of
the places. Against it stand
  chi-squared: the statistic against a uniform alphabet, under the null approximately normal with the moments of a
               non-central chi-squared; a random token's is far below it
  runs:        the runs of character classes; a random token has far more
A token must stand out in both: the two z values are added by Stouffer's rule if both reach GUARD (low for the smaller
alphabets, whose short tokens leave the chi-squared test little to see). exp(-z*z/2)/2 bounds the p-value from above. A token whose serial
correlation is off zero by over 3 standard errors (counting sequences, repeated patterns) is not random and gets p = 1.
Benjamini-Hochberg at level FDR then runs within each band of lengths, over all tokens of the corpus, on p-values binned
upwards by quarters of a decade: what is counted is a table of at most a few hundred rows, whatever the corpus.

Null text: as empty, no spans. Repeated rows, null ids: a result row each. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The given patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, RUN = r"AKIA[A-Z0-9]+", r"[0-9a-f]+", r"[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
FDR, BANDS, TOP_BIN = 0.01, (28, 40, 64), 200
#: k times the sum of squared symbol shares of writing, less 1, by alphabet; share of places at which classes change in it.
UNEVEN, CHANGE = {16: 0.6, 32: 1.1, 64: 3.0}, {16: 0.1, 32: 0.05, 64: 0.2}
#: What each test's z value must reach for their sum to count.
GUARD = {16: 0.5, 32: 0.5, 64: 2.5}
MASK = "[SECRET]"


def _places(text: Column, pattern: str, kind: int, keep=None, group: int | None = None) -> Column:
    """Spans (start, kind, end) of a pattern's matches, in code points; keep: of a match's group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.arrays_zip(found.alias("f"), judged.alias("g"), gaps.alias("s")).alias("z"), lambda x: F.struct(x["s"].alias("gap"), F.coalesce(F.length(x["f"]), F.lit(0)).alias("size"), x["g"].alias("g")))

    def one(x: Column, before: Column) -> Column:
        start = before + x["gap"]
        ok = x["g"].isNotNull() & (keep(x["g"]) if keep else F.lit(True))
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"), ok.alias("ok"))

    placed = common.let(sizes, lambda z: F.zip_with(z, common.befores(F.transform(z, lambda x: x["gap"] + x["size"]), lambda a, x: a + x), one))
    return F.transform(F.filter(placed, lambda x: x["ok"]), _span)


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _span(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))


_NONE = "array<struct<start:int,kind:int,end:int>>"


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end), of the three base kinds, by kind and start. text must not be null."""
    none = F.array().cast(_NONE)
    return F.concat(
        F.when(text.rlike(ASSIGN), _places(text, ASSIGN, 0, lambda g: F.length(g) >= MIN_VALUE, 2)).otherwise(none),
        F.when(text.rlike(ACCESS), _places(text, ACCESS, 1, lambda g: F.length(g) >= MIN_ACCESS)).otherwise(none),
        F.when(text.rlike(f"{HEX[:-1]}{{{MIN_HEX}}}"), _places(text, HEX, 2, lambda g: F.length(g) >= MIN_HEX)).otherwise(none),
    )


def _score(t: Column) -> Column:
    """(band, bin) of a token: its band of lengths, and minus four times the decimal logarithm of its p-value, rounded down."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    squares = total(F.transform(F.array_distinct(F.split(t, "")), lambda c: F.pow(F.length(t) - F.length(F.replace(t, c, F.lit(""))), F.lit(2.0))))
    runs = F.size(F.split(t, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=-])(?=[A-Za-z0-9])")) - 1
    k = F.when(t.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16).when(t.rlike("^[A-Z2-7]+=*$"), 32).otherwise(64)
    codes = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))

    def moments(v: Column) -> Column:
        """About the mean: sum of squares, sum of products of neighbours."""
        spread = lambda m: total(F.transform(v, lambda x: (x - m) * (x - m)))
        lagged = lambda m: total(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda x, y: (x - m) * (y - m)))
        return common.let(total(v) / F.size(v), lambda m: F.struct(spread(m).alias("spread"), lagged(m).alias("lagged")))

    seen = F.struct(F.length(t).cast("double").alias("n"), k.alias("k"), squares.alias("squares"), runs.alias("runs"), common.let(codes, moments).alias("m"))
    return common.let(seen, _judged)


def _judged(a: Column) -> Column:
    n, k = a["n"], a["k"]
    of = lambda given: F.when(k == 16, float(given[16])).when(k == 32, float(given[32])).otherwise(float(given[64]))
    uneven, change, guard = of(UNEVEN), of(CHANGE), of(GUARD)
    z_chi = (k - 1 + n * uneven - (k * a["squares"] / n - n)) / F.sqrt(2 * (k - 1) + 4 * n * uneven)
    z_runs = (a["runs"] - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
    serial = F.when(a["m"]["spread"] == 0, 99.0).otherwise(F.abs(a["m"]["lagged"] / a["m"]["spread"] + 1 / n) * F.sqrt(n))
    z = F.when(F.least(z_chi, z_runs) >= guard, (z_chi + z_runs) / F.sqrt(F.lit(2.0))).otherwise(0.0)
    tens = F.when((z <= 0) | (serial > 3), 0.0).otherwise((z * z / 2 + F.log(F.lit(2.0))) / F.log(F.lit(10.0)))
    band = F.when(n < BANDS[0], 0).when(n < BANDS[1], 1).when(n < BANDS[2], 2).otherwise(3)
    return F.struct(band.alias("band"), F.least(F.floor(tens * 4), F.lit(TOP_BIN)).cast("int").alias("bin"))


def tokens(text: Column) -> Column:
    """Array of (start, end, band, bin) of the text's long runs."""
    found = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    made = F.zip_with(_places(text, RUN, 3), found, lambda p, t: F.struct(p["start"].alias("start"), p["end"].alias("end"), _score(t).alias("s")))
    return F.when(text.rlike(RUN), made).otherwise(F.array().cast("array<struct<start:int,end:int,s:struct<band:int,bin:int>>>"))


def cuts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: least, the array of each band's least bin that false-discovery control lets through (above TOP_BIN: none)."""
    one = docs.where(F.col(text_col).rlike(RUN)).select(F.explode(tokens(F.col(text_col))).alias("t")).groupBy("t.s.band", "t.s.bin").agg(F.count("*").alias("n"))
    by = one.groupBy("band").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    over = lambda b: F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bin"] >= b["bin"], x["n"]).otherwise(0))
    passed = F.filter("bins", lambda b: F.pow(F.lit(10.0), -b["bin"] / 4.0) * total <= FDR * over(b))
    cut = by.select("band", F.coalesce(F.array_min(F.transform(passed, lambda b: b["bin"])), F.lit(TOP_BIN + 1)).alias("bin"))
    named = cut.agg(F.map_from_entries(F.collect_list(F.struct("band", "bin"))).alias("m"))
    return named.select(F.transform(F.array(*map(F.lit, range(len(BANDS) + 1))), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(TOP_BIN + 1))).alias("least"))


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and two columns: __base and __spans, sorted arrays of (start, kind, end); kind numbers as in KINDS.

    The one row of cuts is broadcast. Columns of docs are kept as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("__base", F.array_sort(base_spans(text)))
    least = F.broadcast(cuts(docs, text_col).withColumnRenamed("least", "__least"))
    passed = F.filter(tokens(text), lambda t: t["s"]["bin"] >= F.element_at(F.col("__least"), t["s"]["band"] + 1))
    random = F.transform(passed, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    more = common.let(random, lambda t: F.when((F.size(t) == 0) | (F.size("__base") == 0), t).otherwise(_clear(t, F.col("__base"))))
    return found.join(least).withColumn("__spans", F.array_sort(F.concat("__base", more))).drop("__least")


def _clear(some: Column, others: Column) -> Column:
    """Those of some spans that overlap none of the others; some do not overlap each other, and their kind number is greater."""
    far = 2**31 - 1
    is_some = lambda x: x["kind"] == KINDS.index("random")

    def of(both: Column) -> Column:
        reach = common.befores(F.transform(both, lambda x: F.when(is_some(x), 0).otherwise(x["end"])), _most)
        ahead = F.reverse(common.befores(F.reverse(F.transform(both, lambda x: F.when(is_some(x), 0).otherwise(far - x["start"]))), _most))
        seen = F.zip_with(F.zip_with(both, reach, lambda x, r: F.struct(*(x[k].alias(k) for k in ("start", "kind", "end")), r.alias("reach"))), ahead, lambda x, a: F.struct(*(x[k].alias(k) for k in ("start", "kind", "end", "reach")), (far - a).alias("ahead")))
        return F.transform(F.filter(seen, lambda x: is_some(x) & (x["reach"] <= x["start"]) & (x["ahead"] >= x["end"])), _span)

    return common.let(F.array_sort(F.concat(others, some)), of)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans over whole documents."""
    got = with_spans(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return got.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(written(F.col("__base")), 256).alias("base_sha256"), written(F.col("__spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each maximal run of overlapping spans as MASK; spans must not be empty."""
    ends = common.befores(F.transform(spans, lambda s: s["end"]), _most)
    gaps = F.filter(F.zip_with(spans, ends, lambda s, e: F.struct(e.alias("at"), s["start"].alias("to"))), lambda g: g["at"] <= g["to"])
    last = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("at"), F.length(text).alias("to"))
    return F.array_join(common.pieces(text, F.concat(gaps, F.array(last))), MASK)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span of each text is masked and n_chars follows; no document goes."""
    got = with_spans(docs)
    text = F.when(F.size("__spans") > 0, redacted(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    made = got.withColumn("text", text)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)


def _sql() -> str:
    """All of op1 as SQL: places from the lengths of matches and of what lies between, the battery over lists of characters."""
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    assign = q(ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", either))

    def found(name: str, kind: int, pattern: str, group: int) -> str:
        before = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        return f"""{name} AS (SELECT doc_id, {kind} AS kind, CAST({before} AS BIGINT) AS a, CAST({before} + length(m[i]) AS BIGINT) AS e, v[i] AS v
  FROM (SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {group}) AS v, string_split_regex(t, {pattern}) AS g FROM d)))"""

    of = lambda given: "CASE k WHEN 16 THEN {} WHEN 32 THEN {} ELSE {} END".format(*(f"{float(given[x])!r}::DOUBLE" for x in (16, 32, 64)))
    band = " ".join(f"WHEN n < {x} THEN {i}" for i, x in enumerate(BANDS))
    names = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(KINDS))
    joined = f"string_agg(CASE kind {names} END || ':' || a || ':' || e, ',' ORDER BY a, kind, e)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{found("assigned", 0, assign, 2)}, {found("accesses", 1, q(ACCESS), 0)}, {found("hexes", 2, q(HEX), 0)}, {found("long_runs", 3, q(RUN), 0)},
base AS (SELECT doc_id, kind, a, e FROM assigned WHERE length(v) >= {MIN_VALUE} UNION ALL SELECT doc_id, kind, a, e FROM accesses WHERE length(v) >= {MIN_ACCESS} UNION ALL SELECT doc_id, kind, a, e FROM hexes WHERE length(v) >= {MIN_HEX}),
chars AS (SELECT *, length(v)::DOUBLE AS n, string_split(v, '') AS cs, CASE WHEN regexp_full_match(v, '[0-9a-f]+|[0-9A-F]+') THEN 16 WHEN regexp_full_match(v, '[A-Z2-7]+=*') THEN 32 ELSE 64 END AS k FROM long_runs),
seen AS (SELECT *, list_transform(cs, lambda c: ascii(c)::DOUBLE) AS codes, list_transform(cs, lambda c: CASE WHEN c BETWEEN 'a' AND 'z' THEN 1 WHEN c BETWEEN 'A' AND 'Z' THEN 2 WHEN c BETWEEN '0' AND '9' THEN 3 ELSE 4 END) AS kinds,
  list_sum(list_transform(list_distinct(cs), lambda c: (length(v) - length(replace(v, c, '')))::DOUBLE ** 2)) AS squares, {of(UNEVEN)} AS uneven, {of(CHANGE)} AS change, {of(GUARD)} AS guard FROM chars),
means AS (SELECT *, list_sum(codes) / n AS mean, len(list_filter(range(1, len(kinds)), lambda i: kinds[i] <> kinds[i + 1])) AS runs FROM seen),
spreads AS (SELECT *, list_sum(list_transform(codes, lambda x: (x - mean) ** 2)) AS spread, list_sum(list_transform(range(1, len(codes)), lambda i: (codes[i] - mean) * (codes[i + 1] - mean))) AS lagged FROM means),
tests AS (SELECT *, (k - 1 + n * uneven - (k * squares / n - n)) / sqrt(2 * (k - 1) + 4 * n * uneven) AS z_chi, (runs - (n - 1) * change) / sqrt((n - 1) * change * (1 - change)) AS z_runs,
  CASE WHEN spread = 0 THEN 99.0 ELSE abs(lagged / spread + 1 / n) * sqrt(n) END AS serial FROM spreads),
sums AS (SELECT *, CASE WHEN least(z_chi, z_runs) >= guard THEN (z_chi + z_runs) / sqrt(2.0::DOUBLE) ELSE 0 END AS z, CASE {band} ELSE {len(BANDS)} END AS band FROM tests),
binned AS (SELECT *, least({TOP_BIN}, floor(4 * CASE WHEN z <= 0 OR serial > 3 THEN 0 ELSE (z * z / 2 + ln(2.0::DOUBLE)) / ln(10.0::DOUBLE) END)) AS bin FROM sums),
cut AS (SELECT x.band, min(x.bin) AS least_bin FROM (SELECT DISTINCT band, bin FROM binned) x
  WHERE (SELECT count(*) FROM binned y WHERE y.band = x.band) * 10.0::DOUBLE ** (-x.bin / 4) <= {FDR}::DOUBLE * (SELECT count(*) FROM binned y WHERE y.band = x.band AND y.bin >= x.bin) GROUP BY x.band),
random AS (SELECT doc_id, kind, a, e FROM binned r JOIN cut USING (band) WHERE bin >= least_bin AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.a < r.e AND b.e > r.a)),
told AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {joined} AS s FROM base GROUP BY doc_id),
every AS (SELECT doc_id, {joined} AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM random) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(told.s, '')) AS base_sha256, coalesce(every.s, '') AS spans
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN every USING (doc_id)
"""


ORACLE_SQL = _sql()
