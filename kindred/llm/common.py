"""What the operators of this subpackage share: the folder for cut lineage, Arrow batches, a fixed-size key filter."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Rows in an Arrow batch; whole texts travel in it, so few.
BATCH_ROWS = 128


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of this process only where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="kindred-"))


#: Rows of a small table (ids, edges, labels) in one file.
FILE_ROWS = 200_000


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written as a Parquet table to the shared folder and read back, which cuts its lineage and survives lost executors.

    rows: about how many a small table has; it is then written to as few files as that takes, not to one a task.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of whole texts that Arrow carries and the Parquet reader decodes (its vectors are single large arrays).

    Only where the session leaves these settings at their defaults; they are read when a plan runs, so they cannot be put back here.
    """
    for key, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS // 2)):
        if not spark.conf.isModifiable(key) or key in _explicit(spark):
            continue
        spark.conf.set(key, str(rows))


def _explicit(spark: SparkSession) -> set[str]:
    """Settings that whoever made the session chose."""
    return {k for k, _ in spark.sparkContext.getConf().getAll()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Bits of a key filter: at least FILTER_MIN, 16 for each key, never over FILTER_MAX (16 MB), so that what is broadcast has a fixed bound.
FILTER_MIN, FILTER_MAX = 16, 27


def key_filter(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """A one-hash Bloom filter of the long column as a uint8 bitmap.

    n: about how many keys there are. False hits are possible (and more of them once n passes the bound), misses are
    not; whoever uses it checks exactly afterwards. The bits are OR-ed on the executors, the driver gets words of 32 bits.
    """
    bits = min(FILTER_MAX, max(FILTER_MIN, int(np.ceil(np.log2(max(n, 1) * 16)))))
    at = F.shiftrightunsigned(F.xxhash64(F.col(column)), 64 - bits)
    words = (
        keys.select(at.alias("at"))
        .select(F.shiftright("at", 5).alias("w"), F.expr("shiftleft(1L, cast(at & 31 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return out


_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def xx_long(x: np.ndarray, seed: int | np.ndarray = 42) -> np.ndarray:
    """XXH64 of each int64, as Spark's xxhash64 of a long column; the hash of one column seeds the next."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(x), dtype=np.uint64) + np.asarray(seed).astype(np.uint64) + _P[4] + np.uint64(8)
        k = x.view(np.uint64) * _P[1]
        k = ((k << np.uint64(31)) | (k >> np.uint64(33))) * _P[0]
        h ^= k
        h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * _P[0] + _P[3]
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        return h ^ (h >> np.uint64(32))


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 keys may be in a key_filter."""
    bits = int(np.log2(len(bitmap))) + 5
    at = xx_long(keys) >> np.uint64(64 - bits)
    return ((bitmap[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)


# array expressions that stay linear in long texts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def runs(items: Column) -> Column:
    """An array that is not empty (bound by let) as an array of its runs of about the square root of its size."""
    width = F.ceil(F.sqrt(F.size(items))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / width).cast("int") - 1), lambda i: F.slice(items, i * width + 1, width))


def befores(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of each int of an array, the fold by op (of identity 0) of all that stand before it.

    A fold that appends copies its array at every step; here it does so within runs of about the square root of the array only.
    """
    none = F.array().cast("array<int>")

    def within(xs: Column, head: Column) -> Column:
        step = lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(xs, F.struct(head.alias("at"), none.alias("out")), step)["out"]

    def whole(v: Column) -> Column:
        return let(runs(v), lambda rs: F.flatten(F.zip_with(rs, within(F.transform(rs, lambda r: F.aggregate(r, F.lit(0), op)), F.lit(0)), within)))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def pieces(text: Column, gaps: Column) -> Column:
    """Substrings of text at an array (not empty) of structs (at, to) in ascending order, code points.

    A substring is found by counting from its text's start, so each run of gaps is first cut out as a whole.
    """

    def of(run: Column) -> Column:
        begin = run[0]["at"]
        part = F.substring(text, begin + 1, F.element_at(run, -1)["to"] - begin)
        return let(part, lambda x: F.transform(run, lambda g: F.substring(x, g["at"] - begin + 1, g["to"] - g["at"])))

    return let(gaps, lambda g: F.flatten(F.transform(runs(g), of)))
