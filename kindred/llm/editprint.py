"""Document fingerprints by a randomised edit embedding.

A shared random walk goes over the characters of the whole text: at step t it writes the character under it and moves on by a bit that t and
the character decide, the same for all texts. It ends past the last character, after about two steps a character. Where
texts differ by an edit their walks part, and later fall back into step, so small edit distance becomes small Hamming
distance of what is written.

The fingerprint samples that: of each of BINS samples the place in the walk is the one of least random key among all places of the
walk, so texts of one length are sampled at the same places, and texts of other lengths at as many of the same places as
their lengths allow. A sample is 8 bits of the BLOCK characters written from its place on, and of the place. The likeness
of two fingerprints is the share of equal samples, less what chance gives: an estimate of the share of the walks in step.

Texts that are alike are found by bit-sampled bands: BANDS bands of WIDTH samples; texts equal in a band are verified by the
likeness of their whole fingerprints (NEAR or more) and joined to classes.

Equal texts have equal fingerprints. Null or empty texts: fingerprint all zeros; two of them are alike (1.0), one and
another text are not (0.0).

The document after another is the next in ascending doc_id (null first; rows of one doc_id by a hash of their text); the
first follows the last. A single document follows itself. Repeated rows: a result row each. class_id is the least doc_id of
the class, null only if all its ids are. An empty table: empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain, cycle, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

BINS, BLOCK, SEED = 128, 4, 9
BANDS, WIDTH, BAND_ROWS, NEAR = 16, 5, 16_384, 0.7
_RNG = np.random.default_rng(SEED)
#: The bits of the walk by step (modulo their number) and symbol; symbol 0 is what follows a text.
_BITS = _RNG.integers(0, 2, (4096, 256), dtype=np.uint8)
_STEPS = [x.tobytes() for x in _BITS]


def _records() -> np.ndarray:
    """Of each sample the places whose random key is less than all before: after place m the next is past x with probability (m + 1) / x."""
    out = np.zeros((BINS, 64), dtype=np.int64)
    for i in range(1, 64):
        out[:, i] = np.minimum(2.0**52, np.ceil((out[:, i - 1] + 1) / _RNG.random(BINS))).astype(np.int64)
    return out


_PLACES = _records()
_SALT = common.mix(np.arange(BINS, dtype=np.uint64) + np.uint64(1))


def symbols(text: str) -> np.ndarray:
    """A symbol (1 to 255) for each code point."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return (common.mix(c) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def walk(sym: bytes, at: int, out: bytearray) -> None:
    """Goes on from place `at` past the end of sym; out: what was written so far."""
    put, end = out.append, len(sym)
    for bits in chain(islice(_STEPS, len(out) % len(_STEPS), None), cycle(_STEPS)):
        if at == end:
            return
        s = sym[at]
        put(s)
        at += bits[s]


#: Steps that all walks of a group take at once; walks of fewer texts than FEW go on one by one.
STRIDE, FEW, GROUP_CHARS = 256, 12, 1 << 23


def walks(syms: list[np.ndarray]) -> list[bytearray]:
    """What the walk over each text writes; all go step by step together."""
    out = [bytearray() for _ in syms]
    size = np.array([len(x) for x in syms], dtype=np.int64)
    first = np.cumsum(size + STRIDE) - size - STRIDE
    flat = np.zeros(int((size + STRIDE).sum()), dtype=np.uint8)
    for x, s in zip(syms, first):
        flat[s : s + len(x)] = x
    on, t = np.flatnonzero(size), 0
    at = first[on]
    while len(on) >= FEW:
        wrote = np.empty((STRIDE, len(on)), dtype=np.uint8)
        for j in range(STRIDE):
            s = flat[at]
            wrote[j] = s
            at += _BITS[t % len(_STEPS)][s]
            t += 1
        for i, x in zip(on.tolist(), wrote.T.copy()):
            out[i] += x.tobytes()
        going = at < first[on] + size[on]
        for i in on[~going].tolist():
            out[i] = out[i].rstrip(b"\0")
        on, at = on[going], at[going]
    for i, a in zip(on.tolist(), (at - first[on]).tolist()):
        walk(syms[i].tobytes(), a, out[i])
    return out


def sample(out: bytearray) -> np.ndarray:
    """BINS samples of 8 bits of what a walk wrote."""
    if not out:
        return np.zeros(BINS, dtype=np.uint8)
    place = _PLACES[np.arange(BINS), (_PLACES < len(out)).sum(axis=1) - 1]
    written = np.frombuffer(bytes(out) + bytes(BLOCK), dtype=np.uint8)
    with np.errstate(over="ignore"):
        h = _SALT + place.astype(np.uint64)
        for k in range(BLOCK):
            h = h * np.uint64(0x100000001B3) ^ written[place + k]
    got = (common.mix(h) >> np.uint64(56)).astype(np.uint8)
    if not got.any():
        got[0] = 1  # all zeros is for empty texts
    return got


def embed(texts: list[str]) -> np.ndarray:
    """One row of BINS uint8 samples for each text."""
    got: list[np.ndarray] = []
    held: list[np.ndarray] = []
    room = 0
    for i, text in enumerate(texts):
        held.append(symbols(text))
        room += len(text)
        if room > GROUP_CHARS or i == len(texts) - 1:
            got += map(sample, walks(held))
            held, room = [], 0
    return np.array(got, dtype=np.uint8).reshape(-1, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of samples."""
    same = (a == b).mean(axis=-1)
    full, other = a.any(axis=-1), b.any(axis=-1)
    return np.where(full & other, np.maximum(0.0, (same - 1 / 256) / (1 - 1 / 256)), np.where(full | other, 0.0, 1.0))


# classes


def _print(batches):
    for b in batches:
        fp = embed([x or "" for x in b.column("__text").to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in fp], pa.binary())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp binary) of every row."""
    common.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    return src.mapInArrow(_print, "doc_id long, fp binary")


def _banded(batches):
    """(band and its samples as one number, node)."""
    for b in batches:
        fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), dtype=np.uint8).reshape(-1, BINS).astype(np.int64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.int64), (len(fp), BANDS)).copy()
        for k in range(WIDTH):
            key = key << 8 | fp[:, k : BANDS * WIDTH : WIDTH]
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], names=["key", "node"])


def _verify(least: float):
    def run(batches):
        for b in batches:
            u, v = [], []
            for members in b.column("m").to_pylist():
                node = np.array([x["node"] for x in members])
                fp = np.frombuffer(b"".join(x["fp"] for x in members), dtype=np.uint8).reshape(-1, BINS)
                left = np.arange(len(node))
                while len(left) > 1:  # a spanning forest by breadth-first search; no pair but its edges is given out
                    queue, left = [left[0]], left[1:]
                    while queue and len(left):
                        at = queue.pop()
                        near = likeness(fp[left], fp[at]) >= least
                        u += [node[at]] * int(near.sum())
                        v += node[left[near]].tolist()
                        queue += left[near].tolist()
                        left = left[~near]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def classes(prints: DataFrame, *, least: float = NEAR, rows: int = BAND_ROWS) -> DataFrame:
    """(fp, class_id) of every distinct fp of prints (doc_id, fp): those that share a band and are alike by `least` or more link.

    Fingerprints are numbered by a hash of theirs; bands go out as (number of the band's samples, node), and only nodes with
    company get their fingerprint. A band's bucket of over `rows` nodes is dealt into slices of about that many; each two
    slices meet in a task of their own, which gives out the edges of a forest only, so every pair is compared and no task
    holds more than two slices.
    """
    own = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("m")).select("fp", "m", F.xxhash64("fp").alias("node")), "nodes")
    banded = common.cut(own.select("fp", "node").mapInArrow(_banded, "key long, node long"), "bands")
    held = banded.join(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").join(own.select("node", "fp"), "node")
    k = F.ceil(F.col("n") / rows).cast("int")
    own_slice = F.pmod(F.xxhash64("node"), k).cast("int")
    others = F.transform(F.filter(F.sequence(F.lit(0), k - 1), lambda x: (x != own_slice) | (k == 1)), lambda x: F.struct(F.least(x, own_slice).alias("a"), F.greatest(x, own_slice).alias("b")))
    groups = held.select("key", "node", "fp", F.explode(others).alias("s")).groupBy("key", "s").agg(F.collect_list(F.struct("node", "fp")).alias("m"))
    edges = groups.select("m").mapInArrow(_verify(least), "u long, v long")
    root = components(edges, own.count())
    named = own.join(root, "node", "left").select("fp", "m", F.coalesce("root", "node").alias("root"))
    return named.join(named.groupBy("root").agg(F.min("m").alias("class_id")), "root").select("fp", "class_id")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = NEAR, rows: int = BAND_ROWS) -> DataFrame:
    """(id, class_id) of every row."""
    prints = common.cut(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    return prints.join(classes(prints, least=least, rows=rows), "fp").select(F.col("doc_id").alias(id_col), "class_id")


# each document, its edited text and the next document

RANGE_ROWS, MOST_RANGES = 2000, 100_000
_ORDER = np.dtype([("id", "<i8"), ("h", "<i8")])  # a null id is the least


def _order(batch) -> np.ndarray:
    """What documents are put in order by: id and hash of the text."""
    out = np.empty(batch.num_rows, dtype=_ORDER)
    out["id"] = batch.column("id").to_numpy()
    out["h"] = np.array([xxhash.xxh64_intdigest((x or "").encode("utf-8", "surrogatepass")) for x in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
    return out


def _keys(batches):
    for b in batches:
        at = _order(b)
        yield pa.RecordBatch.from_arrays([pa.array(at["id"]), pa.array(at["h"])], names=["id", "h"])


def _ranges(at: np.ndarray, bounds: np.ndarray, first: int) -> np.ndarray:
    """The range of each row; rows equal to bounds may be in any range those part, and are dealt to them in turn."""
    low, high = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
    return low + (first + np.arange(len(at))) % (high - low + 1)


def _dealt(sent, number: bool):
    """Each row in its range (kind 0), and the first of each range at the end of the range before it too (kind 1); number: (range, id, h) only."""

    def run(batches):
        bounds, starts, before = sent.value
        seen = 0
        for b in batches:
            at = _order(b) if not number else np.rec.fromarrays([b.column("id").to_numpy(), b.column("h").to_numpy()], dtype=_ORDER)
            where = _ranges(at, bounds, seen)
            seen += len(at)
            if number:
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), b.column("id"), b.column("h")], names=["range", "id", "h"])
                continue
            data = [zlib.compress((x or "").encode("utf-8", "surrogatepass"), 1) for x in b.column("text").to_pylist()]
            lead = np.flatnonzero(starts[where] == at)
            rows = np.concatenate([np.arange(len(at)), lead])
            kind = np.repeat(np.array([0, 1], dtype=np.int32), [len(at), len(lead)])
            which = np.concatenate([where, before[where[lead]]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(kind), pa.array(at["id"][rows]), pa.array(at["h"][rows]), b.column("some").take(pa.array(rows)), pa.array([data[i] for i in rows], pa.binary())], names=["range", "kind", "id", "h", "some", "data"])

    return run


def _pairs(batches):
    """Rows come by range in order; a range ends with the first row of the next (kind 1), which is no result itself."""

    def judged(rows):
        """rows: (id, text, next text)."""
        edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for _, x, y in rows]
        number: dict[str, int] = {}
        own, other, after = (np.array([number.setdefault(x, len(number)) for x in xs]) for xs in ([x for _, x, _ in rows], edited, [y for _, _, y in rows]))
        prints = embed(list(number))
        own, other, after = prints[own], prints[other], prints[after]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in rows], pa.int64()),
                pa.array([len(x[1]) for x in rows], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in edited], pa.binary()),
                *(pa.array([x.tobytes() for x in fp], pa.binary()) for fp in (own, other)),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, after)),
            ],
            names=["doc_id", "n_chars", "edited_sha", "fp", "edited_fp", "near_edited", "near_next"],
        )

    last, held, room = None, [], 0  # last: (range, kind, id, text)
    for b in batches:
        for where, kind, i, some, data in zip(*(b.column(c).to_pylist() for c in ("range", "kind", "id", "some", "data"))):
            text = zlib.decompress(data).decode("utf-8", "surrogatepass")
            if last and last[0] == where and last[1] == 0:
                held.append((last[2], last[3], text))
                room += len(last[3])
                if room > GROUP_CHARS // 2:
                    yield judged(held)
                    held, room = [], 0
            last = (where, kind, i if some else None, text)
    if held:
        yield judged(held)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha, fp, edited_fp, near_edited, near_next), the last but two columns binary, of every row.

    Documents are dealt once (compressed), by ranges of (doc_id, hash); each range also gets the document after its last. Rows of one
    id are parted by their hash, and equal rows, of which any may follow any other, are dealt to several ranges. The driver gets the
    bounds and first keys of at most MOST_RANGES ranges.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    lowest = -(1 << 63)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("id"), F.col("doc_id").isNotNull().alias("some"), "text")
    keys = common.cut(src.select("id", "text").mapInArrow(_keys, "id long, h long"), "keys")
    n = keys.count()
    k = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = np.zeros(0, dtype=_ORDER)
    if k > 1:  # which rows are looked at does not change a result, only the ranges' sizes
        some = keys.where(F.pmod(F.xxhash64("h", "id", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(min(1.0, 20 * k / n) * (1 << 30))).toArrow()
        seen = np.sort(np.rec.fromarrays([some.column("id").to_numpy(), some.column("h").to_numpy()], dtype=_ORDER))
        bounds = seen[np.linspace(0, len(seen), k + 1).astype(int)[1:-1]] if len(seen) else bounds
    sc = spark.sparkContext
    numbered = keys.mapInArrow(_dealt(sc.broadcast((bounds, None, None)), True), "range int, id long, h long")
    least = numbered.groupBy("range").agg(F.min(F.struct("id", "h")).alias("f")).select("range", "f.*").orderBy("range").toArrow()
    at = least.column("range").to_numpy()
    starts, before = np.zeros(len(bounds) + 1, dtype=_ORDER), np.zeros(len(bounds) + 1, dtype=np.int32)
    starts["id"][at], starts["h"][at] = least.column("id").to_numpy(), least.column("h").to_numpy()
    before[at] = np.roll(at, 1)
    dealt = src.mapInArrow(_dealt(sc.broadcast((bounds, starts, before)), False), "range int, kind int, id long, h long, some boolean, data binary")
    dealt = dealt.repartition("range").sortWithinPartitions("range", "kind", "id", "h")
    return dealt.select("range", "kind", "id", "some", "data").mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha binary, fp binary, edited_fp binary, near_edited double, near_next double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id over whole documents."""
    rows = common.cut(with_next(common.table(spark, sf_dir, "documents")), "editprints")
    got = rows.join(classes(rows.select("doc_id", "fp")), "fp")
    hexed = lambda c: F.lower(F.hex(c))
    return got.select("doc_id", "n_chars", hexed("edited_sha").alias("edited_sha256"), hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "class_id")
