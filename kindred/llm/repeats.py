"""Substring dedup after the suffix-array manner: ranks of growing prefixes, dropped once unique, up to the threshold.

Every byte covered by a string of `length` bytes that also starts earlier (smaller doc_id, or same document, earlier start) goes;
strings are judged on the input and never cross documents.

Ranks stand for equality only, so a rank is a hash of its prefix, and a doubled rank the hash of a pair of ranks. Sorting
rank pairs of every byte position would write some tens of times the input; so the first rank is taken at sampled positions.
Of each window of `length` bytes the anchor is its k-byte string of least hash (k about a third of `length`); equal windows
have equal anchors at equal places, so windows need comparing only with windows of equal anchors, and one anchor serves a
run of windows. Rounds:

1. Rank of k bytes, at anchors. Anchors whose rank is unique in the corpus drop out (most do).
2. Rank of the neighbourhood: all bytes of all windows that an anchor serves. Anchors of equal rank pair (anchor,
   neighbourhood) serve equal windows: all but the first lose them. First ones whose anchor has no other
   neighbourhood drop out.
3. Rank of `length` bytes, at every window of the anchors left, by pairs of ranks at growing offsets (k, 2k, length).
   Windows that are not the first of their rank go.

Round 1 sends hashes as packed blocks, dealt by their leading bits; what comes back to the documents is a filter of fixed
size (common.key_filter), which may let unique anchors through to round 2 but loses none. In round 3 anchors are dealt
by rank; those of ranks with over HOT neighbourhoods are dealt window by window instead, so no task holds an unbounded group.
Repeats within a document are resolved in place. At last spans and (compressed) texts meet by document.

Null or empty texts: no bytes, nothing removed; so are texts shorter than `length`. Rows that repeat a doc_id: with equal
texts they are one document and get the same result each; with other texts they are ordered by a checksum of their text.
Null ids come before all others. An empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, SEGMENT, HOT, FLUSH, SEED = 100, 1 << 20, 1024, 1 << 20, 2
#: Of a corpus, by its size as the planner knows it, what one bucket of ranks stands for (an eighth to a sixth of it in memory).
BUCKET_BYTES = 4_000_000
_RNG = np.random.default_rng(SEED)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)
_POWER: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWER or len(_POWER[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for x in (_BASE, pow(_BASE, -1, 2**64)):
            a = np.full(size, np.uint64(x))
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWER[:] = out
    return _POWER[0][:n], _POWER[1][:n]


class Text:
    """Hashes of any substring of up to SEGMENT + LENGTH bytes."""

    def __init__(self, data: bytes):
        a = np.frombuffer(data, dtype=np.uint8)
        n = len(a)
        p, self.inverse = _powers(n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[a] * p, out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        with np.errstate(over="ignore"):
            return common.mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def rolling(self, k: int) -> np.ndarray:
        s = self.sums
        with np.errstate(over="ignore"):
            return common.mix((s[k:] - s[:-k]) * self.inverse[: len(s) - k])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of w."""
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x[:n] if size == w else np.minimum(x[:n], x[w - size : w - size + n])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of the anchor, rank of its neighbourhood, first window, number of windows) of each anchor, in order of windows."""
    k, out = max(1, length // 3 - 1), []
    for s in range(0, max(0, len(data) - length + 1), SEGMENT):
        t = Text(data[s : s + SEGMENT + length - 1])
        h = t.rolling(k)
        at = (_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - k + 1) & _LOW).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.append(lo, len(at)))
        with np.errstate(over="ignore"):
            around = common.mix(t.of(lo, lo + n + length - 1) ^ (n.astype(np.uint64) << np.uint64(40)) ^ (at[lo] - lo).astype(np.uint64))
        out.append((h[at[lo]], around, lo + s, n))
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def _own_first(around: np.ndarray) -> np.ndarray:
    """Places of the first of each rank within a document."""
    return np.sort(np.unique(around, return_index=True)[1])


def _rank_blocks(length: int, bits: int):
    """Round 1, map side: (bucket, packed ranks); a rank seen more than once is there twice."""

    def pack(held):
        g, n = np.unique(np.concatenate(held), return_counts=True)
        g = np.repeat(g, np.minimum(n, 2))
        bucket = (g >> np.uint64(64 - bits)).astype(np.int64)
        rest = (g << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]
        at = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        some = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rest[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())], names=["bucket", "ranks"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for text in b.column("text").to_pylist():
                g, around, _, _ = anchors((text or "").encode(), length)
                if len(g):
                    g = g[_own_first(around)]
                    held.append(g)
                    size += len(g)
                    if size > FLUSH:
                        yield pack(held)
                        held, size = [], 0
        if held:
            yield pack(held)

    return run


def _repeated_ranks(bits: int):
    """Round 1, reduce side: leading bits of the ranks that came more than once."""

    def run(batches):
        for bucket, parts in groupby(_rows(batches, "bucket", "ranks"), key=itemgetter(0)):  # sorted by bucket
            parts = [x for _, x in parts]
            five = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, 5)
            wide = np.zeros((len(five), 8), dtype=np.uint8)
            wide[:, :5] = five
            v, n = np.unique(wide.view(">u8").ravel().astype(np.uint64), return_counts=True)
            got = (v[n > 1] >> np.uint64(bits)) | (np.uint64(bucket) << np.uint64(64 - bits))
            yield pa.RecordBatch.from_arrays([pa.array(_key(got, bits))], names=["rank"])

    return run


def _rows(batches, *columns):
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def _key(g: np.ndarray, bits: int) -> np.ndarray:
    """The part of a rank that round 1 compares."""
    keep = 64 - (40 + bits)
    return ((g >> np.uint64(keep)) << np.uint64(keep)).view(np.int64)


def _neighbourhoods(length: int, bits: int, filt):
    """Round 2, map side: anchors that may have company, first of their kind in a document."""

    def run(batches):
        bitmap = filt.value
        for b in batches:
            out = []
            for i, sub, text in zip(*(b.column(c).to_pylist() for c in ("id", "sub", "text"))):
                g, around, lo, n = anchors((text or "").encode(), length)
                if len(g):
                    first = _own_first(around)
                    first = first[common.may_hold(bitmap, _key(g[first], bits))]
                    out.append((g[first], around[first], np.full(len(first), i), lo[first] + (sub << 32), n[first].astype(np.int32)))
            if out:
                g, around, i, pos, n = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(around.view(np.int64)), pa.array(i), pa.array(pos), pa.array(n)], names=["g", "a", "id", "pos", "n"])

    return run


def _place(i: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """As Spark's xxhash64(id, pos)."""
    return common.xx_long(pos, common.xx_long(i).view(np.int64)).view(np.int64)


def _contents(length: int, bits: int, filt, hot):
    """Round 3, map side: (g, id, pos, bytes) of the anchors left; of hot ranks the windows, packed (kind 1, by bucket of their rank)."""

    def run(batches):
        bitmap, wide = filt.value, hot.value
        held, size = [], 0
        for b in batches:
            out = []
            for i, sub, text in zip(*(b.column(c).to_pylist() for c in ("id", "sub", "text"))):
                data = (text or "").encode()
                g, around, lo, n = anchors(data, length)
                if not len(g):
                    continue
                first = _own_first(around)
                pos = lo[first] + (sub << 32)
                first = first[common.may_hold(bitmap, _place(np.full(len(first), i), pos))]
                is_hot = common.may_hold(wide, g[first].view(np.int64))
                out += [(int(g[k].view(np.int64)), i, int(lo[k]) + (sub << 32), data[lo[k] : lo[k] + n[k] + length - 1]) for k in first[~is_hot]]
                if is_hot.any():
                    parts = first[is_hot]
                    rank = _window_ranks([data[lo[k] : lo[k] + n[k] + length - 1] for k in parts], g[parts], length)
                    pos = np.concatenate([np.arange(lo[k], lo[k] + n[k]) for k in parts]) + (sub << 32)
                    held.append((rank, np.full(len(rank), i), pos))
                    size += len(rank)
            if out:
                g, i, pos, data = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(g), pa.int32()), pa.array(g, pa.int64()), pa.array(i, pa.int64()), pa.array(pos, pa.int64()), pa.array(data, pa.binary())], names=["kind", "g", "id", "pos", "data"])
            if size > FLUSH:
                yield _windows(held, bits)
                held, size = [], 0
        if held:
            yield _windows(held, bits)

    return run


_WINDOW = np.dtype([("rank", "<u8"), ("id", "<i8"), ("pos", "<i8")])


def _windows(held, bits: int) -> pa.RecordBatch:
    """Windows of hot ranks by bucket: of each rank the first, and the second and later ones at once as found (kind 2)."""
    w = np.empty(sum(len(x[0]) for x in held), dtype=_WINDOW)
    w["rank"], w["id"], w["pos"] = (np.concatenate(x) for x in zip(*held))
    w = w[np.lexsort((w["pos"], w["id"], w["rank"]))]
    same = np.concatenate([[False], w["rank"][1:] == w["rank"][:-1]])
    later = same & np.concatenate([[False], w[1:] != w[:-1]])  # a repeated row's window is the same one again
    firsts = w[~same]
    bucket = (firsts["rank"] >> np.uint64(64 - bits)).astype(np.int64)
    some = np.unique(bucket)
    at = np.searchsorted(bucket, np.append(some, 1 << bits))
    kinds, gs, data = [1] * len(some), some.tolist(), [firsts[x:y].tobytes() for x, y in zip(at, at[1:])]
    gone = w[later]
    for s in range(0, len(gone), 4096):
        kinds.append(2)
        gs.append(s)
        data.append(gone[s : s + 4096].tobytes())
    n = len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(gs, pa.int64()), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64()), pa.array(data, pa.binary())], names=["kind", "g", "id", "pos", "data"])


def _window_ranks(parts: list[bytes], g: np.ndarray, length: int) -> np.ndarray:
    """Ranks of `length` bytes of all windows of the parts, by doubling; g: the parts' anchors' ranks."""
    data = b"".join(parts)
    size = np.array([len(x) for x in parts])
    end = np.cumsum(size)
    first = end - size
    n = size - length + 1
    start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    k = max(1, length // 3 - 1)
    out = np.empty(len(start), dtype=np.uint64)
    step = SEGMENT // 2
    for s in range(0, len(start), step):
        at = start[s : s + step]
        base = at[0]
        rank, have = Text(data[base : at[-1] + length]).rolling(k), k
        with np.errstate(over="ignore"):
            while have < length:
                more = min(have, length - have)
                rank = common.mix(rank[: len(rank) - more] * np.uint64(3) + rank[more:])
                have += more
        out[s : s + step] = rank[at - base]
    with np.errstate(over="ignore"):
        return common.mix(out + np.repeat(g, n) * np.uint64(5))


def _spans(i: np.ndarray, pos: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of windows as spans (id, pos, end); rows in order of (id, pos)."""
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (pos[1:] != pos[:-1] + 1)]) if len(i) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(i))[: len(at)] - 1
    return pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(pos[at]), pa.array(pos[last] + length)], names=["id", "pos", "end"])


def _later_windows(length: int):
    """Round 3, reduce side of contents: spans of windows that aren't the first of their rank. Rows come with all of their g."""

    def judge(rows):
        parts, g, i, pos = rows
        g = np.array(g, dtype=np.int64).view(np.uint64)
        rank = _window_ranks(parts, g, length)
        n = np.array([len(x) for x in parts]) - length + 1
        where = np.repeat(np.array(pos, dtype=np.int64) - (np.cumsum(n) - n), n) + np.arange(n.sum())
        who = np.repeat(np.array(i, dtype=np.int64), n)
        order = np.lexsort((where, who, rank))
        a, b = order[1:], order[:-1]
        later = a[(rank[a] == rank[b]) & ((who[a] != who[b]) | (where[a] != where[b]))]  # a repeated row's window is the same one again
        later = later[np.lexsort((where[later], who[later]))]
        return _spans(who[later], where[later], length)

    def run(batches):
        held: tuple[list, list, list, list] = ([], [], [], [])
        for b in batches:  # sorted by g
            for data, g, i, pos in zip(*(b.column(c).to_pylist() for c in ("data", "g", "id", "pos"))):
                if len(held[0]) > 8 * HOT and g != held[1][-1]:
                    yield judge(held)
                    held = ([], [], [], [])
                for x, y in zip(held, (data, g, i, pos)):
                    x.append(y)
        if held[0]:
            yield judge(held)

    return run


def _later_packed(length: int):
    """Round 3, reduce side of packed windows: those of a bucket together."""

    def run(batches):
        for (kind, _), parts in groupby(_rows(batches, "kind", "g", "data"), key=itemgetter(0, 1)):  # sorted by (kind, g)
            if kind == 2:
                for _, _, data in parts:
                    w = np.frombuffer(data, dtype=_WINDOW)
                    w = w[np.lexsort((w["pos"], w["id"]))]
                    yield _spans(w["id"], w["pos"], length)
                continue
            w = np.frombuffer(b"".join(x for _, _, x in parts), dtype=_WINDOW)
            w = w[np.lexsort((w["pos"], w["id"], w["rank"]))]
            w = w[1:][(w["rank"][1:] == w["rank"][:-1]) & (w[1:] != w[:-1])]
            w = w[np.lexsort((w["pos"], w["id"]))]
            yield _spans(w["id"], w["pos"], length)

    return run


def _texts(batches):
    for b in batches:
        data = [zlib.compress((x or "").encode(), 1) for x in b.column("text").to_pylist()]
        z = pa.array(np.zeros(len(data), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sub"), z, z, pa.array(data, pa.binary()), b.column("some")], names=["id", "sub", "start", "end", "data", "some"])


def _kept(length: int):
    """Spans of a document, then its text (data not null)."""

    def run(batches):
        at, spans = None, []
        for b in batches:
            out = []
            for i, sub, start, end, data, some in zip(*(b.column(c).to_pylist() for c in ("id", "sub", "start", "end", "data", "some"))):
                if (i, sub) != at:
                    at, spans = (i, sub), []
                if data is None:
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                    continue
                text = zlib.decompress(data)
                _, around, lo, n = anchors(text, length)
                again = np.ones(len(around), dtype=bool)
                again[_own_first(around)] = False
                edge = np.zeros(len(text) + 1, dtype=np.int32)
                s = np.array(spans, dtype=np.int64).reshape(-1, 2)
                np.add.at(edge, np.concatenate([s[:, 0], lo[again]]), 1)
                np.add.at(edge, np.concatenate([s[:, 1], (lo + n + length - 1)[again]]), -1)
                gone = np.cumsum(edge[:-1]) > 0
                keep = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((i if some else None, len(text), len(text) - len(keep), runs, keep))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) of every row."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    common.small_batches(spark)
    lowest = -(1 << 63)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("id"))
    n = ids.count()
    many = not ids.groupBy("id").count().where("count > 1").isEmpty()
    sub = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).bitwiseAND(0x7FFFFFFF) if many else F.lit(0).cast("long")
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("id"), sub.alias("sub"), F.col(text_col).alias("text"))
    size = int(str(docs.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = int(min(20, max(8, np.ceil(np.log2(max(1, n / 4000, min(size, n * 1_000_000) / BUCKET_BYTES))))))

    ranks = src.select("text").mapInArrow(_rank_blocks(length, bits), "bucket int, ranks binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated_ranks(bits), "rank long")
    ranks = common.cut(ranks, "ranks")
    filt = sc.broadcast(common.key_filter(ranks, "rank", ranks.count()))
    met = common.cut(src.mapInArrow(_neighbourhoods(length, bits, filt), "g long, a long, id long, pos long, n int"), "anchors")
    firsts = common.cut(met.groupBy("g", "a").agg(F.min(F.struct("id", "pos")).alias("f"), F.count("*").alias("c")).select("g", "a", F.col("f.id").alias("fid"), F.col("f.pos").alias("fpos"), "c"), "firsts")
    again = met.join(firsts.where("c > 1").select("g", "a", "fid", "fpos"), ["g", "a"]).where("id <> fid or pos <> fpos")
    spans = again.select("id", "pos", (F.col("pos") + F.col("n") + (length - 1)).alias("end"))

    wide = common.cut(firsts.groupBy("g").agg(F.count("*").alias("k")).where("k > 1"), "wide")
    left = common.cut(firsts.join(wide, "g", "left_semi").select(F.xxhash64("fid", "fpos").alias("place")), "left")
    hot = wide.where(F.col("k") > HOT)
    filt2 = sc.broadcast(common.key_filter(left, "place", left.count()))
    filt3 = sc.broadcast(common.key_filter(hot, "g", hot.count()))
    contents = src.mapInArrow(_contents(length, bits, filt2, filt3), "kind int, g long, id long, pos long, data binary")
    contents = common.cut(contents, "contents")
    out = "id long, pos long, end long"
    spans = spans.unionByName(contents.where("kind = 0").repartition("g").sortWithinPartitions("g").mapInArrow(_later_windows(length), out))
    spans = spans.unionByName(contents.where("kind > 0").repartition("kind", "g").sortWithinPartitions("kind", "g").mapInArrow(_later_packed(length), out))

    half = F.lit((1 << 32) - 1)
    some = spans.select("id", F.shiftright("pos", 32).alias("sub"), F.col("pos").bitwiseAND(half).alias("start"), F.col("end").bitwiseAND(half).alias("end"), F.lit(None).cast("binary").alias("data"), F.lit(True).alias("some"))
    texts = src.withColumn("some", F.col("id") != lowest).mapInArrow(_texts, "id long, sub long, start long, end long, data binary, some boolean")
    both = some.unionByName(texts).repartition("id", "sub").sortWithinPartitions("id", "sub", F.col("data").isNotNull(), "start")
    return both.mapInArrow(_kept(length), "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 over whole documents."""
    got = remove_repeats(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The contract said plainly: every string of LENGTH bytes (two hexadecimal digits each) against the first place that holds it.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents)),
part AS (SELECT doc_id, b, substr(h, 2 * b + 1, 2 * (1000 + {LENGTH - 1})) AS t FROM (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1}, 1000)) AS b FROM d)),
win AS (SELECT doc_id, b + i AS p, substr(t, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, b, t, unnest(range(0, least(1000, length(t) // 2 - {LENGTH - 1}))) AS i FROM part)),
head AS (SELECT s, min(struct_pack(doc_id, p)) AS f FROM win GROUP BY s HAVING count(*) > 1),
later AS (SELECT win.doc_id, p FROM win JOIN head USING (s) WHERE win.doc_id <> f.doc_id OR p <> f.p),
isle AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS new FROM later)),
gone AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS e FROM isle GROUP BY doc_id, g),
edge AS (SELECT doc_id, a, e FROM gone UNION ALL SELECT doc_id, n, n FROM d),
gap AS (SELECT doc_id, a, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a, e), 0) AS o FROM edge),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * o + 1, 2 * (a - o)), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS r, count(*) AS c FROM gone GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""
