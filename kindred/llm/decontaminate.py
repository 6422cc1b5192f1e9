"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. The windows of an item are its runs of
N_WORDS consecutive words; an item of fewer words, but not none, is one window. Each document is normalised once to its
words joined by one space, scanned once, and the hits are mapped to its words and to code points of the original text.

The benchmark is a query set whose size is checked: it goes out in blocks of at most BLOCK_CHARS characters of window
text, one automaton each, so what is broadcast is bounded however large the benchmark is.

Null or empty texts have no words (n_words 0, not contaminated). Repeated rows give repeated rows. Null item_ids count as
the empty string; repeated items with one id count once. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N_WORDS = 10
BLOCK_CHARS = 8_000_000
#: Words of a text as it is given (A-Z not yet lower-cased), and what the pattern means for one byte of UTF-8: bytes of other
#: characters are kept, A-Z is lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TO = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BUILT: dict[str, object] = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO).split()


def windows(text: str | None, n: int = N_WORDS) -> set[str]:
    """The windows of an item, each between spaces, bytes as Latin-1 characters."""
    w = words(text)
    return {" " + b" ".join(w[i : i + n]).decode("latin-1") + " " for i in range(max(1, len(w) - n + 1))} if w else set()


def automaton(key: str, items: list[tuple[str, str]], n: int):
    """Built once for each Python worker; a window holds the numbers of its items and its count of words."""
    if key not in _BUILT:
        _BUILT.clear()
        of: dict[str, list[int]] = {}
        for i, (_, text) in enumerate(items):
            for x in windows(text, n):
                of.setdefault(x, []).append(i)
        made = ahocorasick.Automaton()
        for x, who in of.items():
            made.add_word(x, (tuple(who), x.count(" ") - 1))
        if of:
            made.make_automaton()
        _BUILT[key] = made if of else None
    return _BUILT[key]


def hits(made, norm: bytes) -> tuple[list[tuple[int, int]], set[int]]:
    """Word ranges (first, past the last) that windows cover, overlapping ones merged, and the items hit; norm: words with a space around each."""
    if made is None:
        return [], set()
    found = list(made.iter(norm.decode("latin-1")))
    if not found:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    last = np.searchsorted(spaces, np.array([end for end, _ in found]))  # the closing space's number is that of the next word
    spans, who = [], set()
    for past, (_, (items, size)) in sorted(zip(last.tolist(), found), key=lambda x: x[0] - x[1][1][1]):
        who.update(items)
        if spans and past - size < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], past)
        else:
            spans.append([past - size, past])
    return [(a, b) for a, b in spans], who


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans in the text as given of the word ranges."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N_WORDS) -> Iterator[list[tuple[str, str]]]:
    """The query set in blocks of bounded size, streamed to the driver a partition at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        own = len(r.t.encode()) * n
        if rows and size + own > BLOCK_CHARS:
            yield rows
            rows, size = [], 0
        rows.append((r.i, r.t))
        size += own
    yield rows


def _scan(key: str, items, n: int, spans: bool, keys: tuple[str, ...] = ("__id",)):
    def run(batches):
        made = automaton(key, items.value, n)
        names = [i for i, _ in items.value]
        for batch in batches:
            out = {"n_words": [], "ranges": [], "items": [], "spans": []}
            for text in batch.column("__text").to_pylist():
                w = words(text)
                ranges, who = hits(made, b" " + b" ".join(w) + b" ") if w else ([], set())
                out["n_words"].append(len(w))
                out["ranges"].append([x for r in ranges for x in r])
                out["items"].append(sorted({names[i] for i in who}))
                out["spans"].append([x for r in original_spans(text, ranges) for x in r] if spans and ranges else [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(out["n_words"], pa.int64()), *(pa.array(out[k], pa.list_(pa.int32())) for k in ("ranges",)), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], pa.list_(pa.int32()))],
                names=[*keys, "n_words", "ranges", "items", "spans"],
            )

    return run


def _key(items: list[tuple[str, str]], n: int) -> str:
    return hashlib.sha256(repr((n, items)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N_WORDS, spans: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, ranges (word ranges hit, flat pairs), items (ids), spans (code-point spans, flat pairs, if asked for).

    With a benchmark of several blocks the rows are numbered in a table of the shared folder, scanned once for each block,
    and put together by number, so each row stays a row. No other column of docs is read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    schema = f"__id {dict(src.dtypes)['__id']}, n_words long, ranges array<int>, items array<string>, spans array<int>"
    parts = [(_key(items, n), spark.sparkContext.broadcast(items)) for items in blocks(benchmark, item_col, item_text_col, n)]
    if len(parts) == 1:
        return src.mapInArrow(_scan(*parts[0], n, spans), schema).withColumnRenamed("__id", id_col)
    numbered = common.cut(src.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    whole = None
    for key, sent in parts:
        got = numbered.mapInArrow(_scan(key, sent, n, spans, ("__row", "__id")), f"__row long, {schema}")
        whole = got if whole is None else whole.unionByName(got.where(F.size("items") > 0))
    flat = whole.groupBy("__row").agg(F.first("__id").alias("__id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return flat.drop("__row").mapInArrow(_merge, schema).withColumnRenamed("__id", id_col)


def merged(flat: list[int]) -> list[int]:
    """Flat pairs as the union of their ranges."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a < out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _merge(batches):
    for batch in batches:
        cols = {k: batch.column(k) for k in batch.schema.names}
        for k in ("ranges", "spans"):
            cols[k] = pa.array([merged(x) for x in cols[k].to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def hit_words(ranges):
    """How many words flat, merged ranges hold."""
    return F.aggregate(F.transform(ranges, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated over whole documents and benchmark."""
    got = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("ranges"))
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold any benchmark window go, all others stay with their columns as they are."""
    common.small_batches(spark)
    kept, sets = docs, list(blocks(common.table(spark, sf_dir, "benchmark")))
    for items in sets:
        sent = spark.sparkContext.broadcast(items)
        kept = kept.mapInArrow(_clean(_key(items, N_WORDS), sent, N_WORDS), docs.schema)
    return kept


def _clean(key: str, items, n: int):
    def run(batches):
        made = automaton(key, items.value, n)
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                w = words(text)
                keep.append(not (w and made is not None and next(made.iter((b" " + b" ".join(w) + b" ").decode("latin-1")), None)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


_WORDS_SQL = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, w, least({N_WORDS}, len(w)) AS n FROM (SELECT item_id, {_WORDS_SQL.format(t="coalesce(text, '')")} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(hi.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
