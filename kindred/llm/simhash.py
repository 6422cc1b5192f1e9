"""SimHash near-duplicates: pigeonring filtering before the full Hamming check.

Fingerprint: texts are ASCII-lower-cased, cut into words at ASCII white space, and each run of SHINGLE words (repeats
included, joined by one space; fewer words: all of them) is hashed by XXH64, seed 42. A bit is 1 if set in over half of
the hashes. No words: fingerprint zero.

Links: two fingerprints link at DISTANCE or fewer differing bits. Equal fingerprints are one node. A fingerprint's 64 bits
are SEGMENTS segments on a ring. If d <= 4 bits differ over 5 segments, then some start on the ring has every chain of l
segments within l*4/5 differences (rounded down): none in the first, one in the first two, two in the first three,
three in the first four. The index enforces the first three: the first segment equal, and of the four halves of the next
two segments a pair that the budgets leave equal (five pairs do). So a fingerprint has 25 keys of about 26 bits. Within a
bucket the chain of four is checked, then the full distance.

No pair is emitted but those of a spanning forest of each bucket, found by breadth-first search in numpy over at most
BUCKET_ROWS fingerprints. Fingerprints in a larger bucket go another, exact way that is linear in their number: two are
within 4 bits exactly if some word is within 2 bits of both, so each meets its 2,081 words, and each word links those
who meet there (all within 4 bits of each other) to their least.

Null or empty texts: fingerprint zero, linked like any other. Repeated rows share their doc_id's component. component_id is
null only if all ids of a component are null. An empty table gives an empty result. Other columns of docs are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, DISTANCE, SEGMENTS, SEED = 4, 4, 5, 42
BUCKET_ROWS = 16_384
#: Fingerprints whose 25 keys each one task makes (adaptive execution would size tasks by what comes in, a 25th of it), and the most tasks for it.
KEY_ROWS, KEY_TASKS = 50_000, 20_000
_STARTS = (0, 13, 26, 39, 52, 64)


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    norm = b" ".join(w)
    if len(w) <= n:
        h = [xxhash.xxh64_intdigest(norm, SEED)]
    else:
        at = [0, *accumulate(len(x) + 1 for x in w)]
        digest = xxhash.xxh64_intdigest
        h = [digest(norm[s : e - 1], SEED) for s, e in zip(at, at[n:])]
    bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        fp = np.array([fingerprint(x) for x in b.column("__text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(fp.view(np.int64))], names=["__id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row."""
    common.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return src.mapInArrow(_fingerprints, "__id long, fp long").withColumnRenamed("__id", id_col)


def _bits(start: int, stop: int) -> int:
    return (1 << stop) - (1 << start)


def patterns() -> list[tuple[int, int]]:
    """(start segment, mask of the bits that must be equal): 25 of them."""
    out = []
    for i in range(SEGMENTS):
        first = _bits(_STARTS[i], _STARTS[i + 1])
        halves = []
        for j in (i + 1, i + 2):
            s, e = _STARTS[j % SEGMENTS], _STARTS[j % SEGMENTS + 1]
            halves.append((_bits(s, (s + e) // 2), _bits((s + e) // 2, e)))
        (a1, a2), (b1, b2) = halves
        out += [(i, first | x) for x in (a1 | a2, a1 | b1, a1 | b2, a2 | b1, a2 | b2)]
    return out


def chain_ok(x: np.ndarray, start: int) -> np.ndarray:
    """Whether differences x keep, from the start segment on, each chain within its proportional budget."""
    ok, total = np.ones(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    for n in range(SEGMENTS):
        j = (start + n) % SEGMENTS
        total += np.bitwise_count(x & np.uint64(_bits(_STARTS[j], _STARTS[j + 1])))
        ok &= total <= (n + 1) * DISTANCE // SEGMENTS
    return ok


def forest(members: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links that a bucket's chains let through (others are found from other buckets)."""
    left, out = members, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            x = left ^ at
            near = chain_ok(x, start)
            near[near] = np.bitwise_count(x[near]) <= DISTANCE
            found = left[near]
            out += [(at, y) for y in found]
            queue += list(found)
            left = left[~near]
    return out


def _link(batches):
    masks = patterns()
    for b in batches:
        u: list[np.ndarray] = []
        v: list[np.ndarray] = []
        pid = b.column("pid").to_numpy()
        offsets = b.column("fps").offsets.to_numpy()
        flat = b.column("fps").values.to_numpy().view(np.uint64)
        size = np.diff(offsets)
        two = np.flatnonzero(size == 2)
        for start in range(SEGMENTS):
            rows = two[pid[two] // 5 == start]
            p, q = flat[offsets[rows]], flat[offsets[rows] + 1]
            x = p ^ q
            ok = chain_ok(x, start)
            ok[ok] = np.bitwise_count(x[ok]) <= DISTANCE
            u.append(p[ok])
            v.append(q[ok])
        for r in np.flatnonzero(size > 2):
            if edges := forest(flat[offsets[r] : offsets[r + 1]], masks[pid[r]][0]):
                e = np.array(edges, dtype=np.uint64)
                u.append(e[:, 0])
                v.append(e[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])


def _near_words(batches):
    one = [np.uint64(1) << np.uint64(i) for i in range(64)]
    flips = np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])], dtype=np.uint64)
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(fp), 64):
            part = fp[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["word", "fp"])


def links(fps: DataFrame, rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) over distinct fps (column fp; about `rows`) with the components of all pairs within DISTANCE bits."""
    spread = fps.select("fp").repartition(min(KEY_TASKS, max(1, -(-rows // KEY_ROWS))))
    keys = spread.select("fp", F.explode(F.array(*(F.struct(F.lit(i).cast("int").alias("pid"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("part")) for i, (_, m) in enumerate(patterns())))).alias("k")).select("fp", "k.pid", "k.part")
    held = common.cut(keys.groupBy("pid", "part").agg(F.count("*").alias("n")).where("n > 1"), "buckets", rows)
    full = common.cut(keys.join(held.hint("merge"), ["pid", "part"]), "members", 4 * rows)  # one plan at every size
    edges = full.where(F.col("n") <= bucket_rows).groupBy("pid", "part").agg(F.collect_list("fp").alias("fps")).select("pid", "fps").mapInArrow(_link, "u long, v long")
    hot = full.where(F.col("n") > bucket_rows)
    if hot.isEmpty():
        return edges
    met = hot.select("fp").distinct().mapInArrow(_near_words, "word long, fp long")
    least = met.groupBy("word").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1").select("word", "m")
    return edges.unionByName(met.join(least, "word").where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fp, component_id) of every row."""
    rows = common.cut(fingerprints(docs, id_col, text_col), "fingerprints")
    n = rows.count()
    own = rows.groupBy("fp").agg(F.min(id_col).alias("m"))
    root = components(links(own.select("fp"), n, bucket_rows), n).withColumnRenamed("node", "fp")
    named = common.cut(own.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots", n)
    least = named.groupBy("root").agg(F.min("m").alias("component_id"))
    label = common.cut(named.join(least, "root").select("fp", "component_id"), "labels", n)
    return rows.join(label, "fp").select(id_col, "fp", "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over whole documents."""
    got = classes(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document of least doc_id stays, once.

    Where rows repeat a doc_id (looked for on ids alone), one row stays, the least by its text. Rows whose doc_id is null stay.
    """
    n = docs.select("doc_id").count()
    got = classes(docs)
    ids = got.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(common.cut(ids, "kept", n).hint("merge"), "doc_id", "left_semi")  # one plan at every size
    many = common.cut(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated", n)
    if not many.isEmpty():
        rank = F.struct(*(F.col(c) for c in ("text", *(c for c in docs.columns if c not in ("text", "doc_id")))))
        once = kept.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rank).alias("r")).select("doc_id", "r.*").select(*docs.columns)
        kept = kept.join(many, "doc_id", "left_anti").unionByName(once)
    none = docs.where("doc_id is null")
    return kept.unionByName(none).select(*docs.columns)
