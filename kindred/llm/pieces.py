"""SentencePiece encoding and decoding with a given public model; giant documents are encoded in chunks.

Unigram models: max-plus parallel scan. A chunk is a run of code points cut anywhere. Its boundary states say how many code
points of the chunk belong to a piece that began in the chunk before (0 .. longest piece - 1). Over each chunk, one pass
gives the transfer matrix: the best score from each state at its left edge to each at its right. Matrices combine by
(max, +), which is associative; a prefix scan over a document's chunks gives the best state at every boundary, and each
chunk is then backtraced on its own between its two states.

BPE models (the public 32k model is one): their segmentation is what greedy merges leave, not the path of the best sum of
scores, so a max-plus scan cannot give right ids. Chunks are cut instead where no merge can cross: at a single space
before a word (no piece holds the space mark after another character) or before a line feed (no piece holds one). There
the boundary has one state, the transfer matrices are 1 x 1, and chunks are independent. Documents of up to CHUNK code
points, and models or texts that offer no such place, are encoded whole.

Null or empty texts have no ids and decode to the empty text. Repeated rows, null ids: a result row each. Decoding is exact but
for U+2581, which the model cannot tell from a space (lossless says so).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from . import common

MODEL, CHUNK, MARK = "/opt/tokenizers/piece_bpe_32k.model", 65_536, "▁"
_LOADED: dict[str, Model] = {}


class Model:
    """A model from the bytes of its file."""

    def __init__(self, data: bytes):
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=data)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        self.unigram = proto.trainer_spec.model_type == 1
        norm = proto.normalizer_spec
        self.plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        usable = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        text = [p.piece for _, p in usable]
        self.space_cuts = self.plain and not any(MARK in x.lstrip(MARK) for x in text)
        self.line_cuts = self.plain and not any("\n" in x for x in text) and MARK in text
        self.pieces = {p.piece: (i, p.score) for i, p in usable}
        self.longest = max(map(len, text), default=1)
        self.unknown = min((p.score for _, p in usable), default=0.0) - 10.0
        self.unk_id = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6} if proto.trainer_spec.byte_fallback else {}

    # max-plus scan of unigram models

    def normal(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def _edges(self, x: str, end: int, after: str):
        """Of each place in the chunk, the (length, score) of pieces that begin there; they may end in `after`."""
        whole = x + after
        for s in range(end):
            got = [(n, self.pieces[whole[s : s + n]][1]) for n in range(1, min(self.longest, len(whole) - s) + 1) if whole[s : s + n] in self.pieces]
            if not got or got[0][0] != 1:
                got.insert(0, (1, self.unknown))
            yield s, got

    def transfer(self, chunk: str, after: str) -> np.ndarray:
        """Best score from each state at the left edge to each at the right; after: the longest - 1 code points that follow."""
        k, n = self.longest, len(chunk)
        best = np.full((n + k, k), -np.inf)
        for state in range(k):
            best[state, state] = 0.0
        for s, got in self._edges(chunk, n, after):
            for size, score in got:
                np.maximum(best[s + size], best[s] + score, out=best[s + size])
        return best[n : n + k].T.copy()

    def backtrace(self, chunk: str, after: str, left: int, right: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the best path between the two states."""
        n = len(chunk)
        best = np.full(n + self.longest, -np.inf)
        back = np.zeros(n + self.longest, dtype=np.int64)
        best[left] = 0.0
        for s, got in self._edges(chunk, n, after):
            for size, score in got:
                if best[s] + score > best[s + size]:
                    best[s + size], back[s + size] = best[s] + score, size
        whole, at, spans = chunk + after, n + right, []
        while at > left:
            spans.append(whole[at - back[at] : at])
            at -= back[at]
        out: list[int] = []
        for x in reversed(spans):
            if x in self.pieces:
                out.append(self.pieces[x][0])
            elif self.bytes:
                out += [self.bytes[b] for b in x.encode()]
            else:
                out.append(self.unk_id)
        return out

    def collapsed(self, ids: list[int]) -> list[int]:
        """Ids of a whole document with each run of unknowns as one, as the library has it."""
        return [x for i, x in enumerate(ids) if self.bytes or x != self.unk_id or not i or ids[i - 1] != x]

    # chunks of BPE models

    def cuts(self, text: str, size: int) -> list[int]:
        """Starts of chunks of about size code points after the first; each lies at a space or line feed where no piece can cross."""
        out, at = [], 0
        while len(text) - at > size:
            p = at + size
            while p + 1 < len(text):
                if self.space_cuts and text[p] == " " and text[p - 1] not in (" ", MARK) and text[p + 1] not in (" ", MARK):
                    break
                if self.line_cuts and text[p] == "\n":
                    break
                p += 1
            if p + 1 >= len(text):
                break
            out.append(p)
            at = p
        return out

    def encode_chunk(self, part: str, first: bool) -> list[int]:
        if first:
            return self.lib.encode(part)
        if part[0] == " ":
            return self.lib.encode(part[1:])  # the model's own prefix is the space
        return self.lib.encode(part)[1:]  # a line feed: less the model's own prefix


def loaded(key: str, data: bytes) -> Model:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model(data)
    return _LOADED[key]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[int]:
    """The best path's state at each chunk's right edge, from the chunks' transfer matrices; the last is 0 by definition."""
    suffix = [matrices[-1][:, :1]]
    for m in reversed(matrices[:-1]):
        suffix.append(combine(m, suffix[-1]))
    suffix.reverse()  # best score from each state at a chunk's left edge to the end
    out, state = [], 0
    for i, m in enumerate(matrices[:-1]):
        state = int((m[state] + suffix[i + 1][:, 0]).argmax())
        out.append(state)
    return [*out, 0]


def encode_unigram(model: Model, text: str, size: int = CHUNK) -> list[int]:
    """Ids by the scan, all chunks here: what encode() does over Spark's rows."""
    x = model.normal(text)
    if not x:
        return []
    parts = [(x[i : i + size], x[i + size : i + size + model.longest - 1]) for i in range(0, len(x), size)]
    right = scan([model.transfer(a, b) for a, b in parts])
    return model.collapsed([y for (a, b), s, e in zip(parts, [0, *right], right) for y in model.backtrace(a, b, s, e)])


def _ids(x: list[int]) -> bytes:
    return np.array(x, dtype="<i4").tobytes()


def _list_array(ids: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(ids), dtype="<i4")
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, dtype=np.int32), ends])), pa.array(flat))


#: What may go with the ids: columns by name, each from (model, texts, ids as binary).
EXTRA = {
    "decoded": ("string", lambda model, texts, ids: pa.array([model.lib.decode(numbers(x)) for x in ids], pa.string())),
    "list": ("array<int>", lambda model, texts, ids: _list_array(ids)),
}


def _with(names):
    """Rows of __id, ids, __text and the named extras; ids of rows that have none yet are made here."""

    def of(key, data):
        def run(batches):
            model = loaded(key, data.value)
            for b in batches:
                texts = [x or "" for x in b.column("__text").to_pylist()]
                ids = b.column("ids").to_pylist() if "ids" in b.schema.names else [_ids(model.lib.encode(x)) for x in texts]
                yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string()), *(EXTRA[n][1](model, texts, ids) for n in names)], names=["__id", "ids", "__text", *names])

        return run

    return of


def _split(key, data, size):
    """Rows of chunks: __id, row (tells rows of one id apart), no, part, after."""

    def run(batches):
        model = loaded(key, data.value)
        for b in batches:
            for i, text in zip(b.column("__id"), b.column("__text").to_pylist()):
                if model.unigram:
                    x = model.normal(text)
                    parts = [(x[s : s + size], x[s + size : s + size + model.longest - 1]) for s in range(0, len(x), size)]
                else:
                    at = [0, *model.cuts(text, size), len(text)]
                    parts = [(text[s:e], "") for s, e in zip(at, at[1:])]
                row = hashlib.sha256(text.encode()).digest()[:12]
                for no, (p, after) in enumerate(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], b.schema.field("__id").type), pa.array([row]), pa.array([no], pa.int32()), pa.array([p]), pa.array([after])], names=["__id", "row", "no", "part", "after"])

    return run


def _encode_parts(key, data):
    def run(batches):
        model = loaded(key, data.value)
        for b in batches:
            ids = [_ids(model.encode_chunk(p, no == 0)) for p, no in zip(b.column("part").to_pylist(), b.column("no").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("row"), b.column("no"), pa.array(ids, pa.binary())], names=["__id", "row", "no", "ids"])

    return run


def _transfers(key, data):
    def run(batches):
        model = loaded(key, data.value)
        for b in batches:
            m = [model.transfer(p, a).ravel().tolist() for p, a in zip(b.column("part").to_pylist(), b.column("after").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("row"), b.column("no"), pa.array(m, pa.list_(pa.float64()))], names=["__id", "row", "no", "m"])

    return run


def _states(batches):
    """From all matrices of a document (numbers only, a few hundred a chunk) the two states of each chunk."""
    for b in batches:
        for i, row, ms in zip(b.column("__id"), b.column("row").to_pylist(), b.column("ms").to_pylist()):
            k = int(np.sqrt(len(ms[0]["m"])))
            right = scan([np.array(x["m"]).reshape(k, k) for x in ms])
            n = len(right)
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * n, b.schema.field("__id").type), pa.array([row] * n), pa.array([x["no"] for x in ms], pa.int32()), pa.array([0, *right[:-1]], pa.int32()), pa.array(right, pa.int32())], names=["__id", "row", "no", "s", "e"])


def _backtraces(key, data):
    def run(batches):
        model = loaded(key, data.value)
        for b in batches:
            ids = [_ids(model.backtrace(p, a, s, e)) for p, a, s, e in zip(*(b.column(c).to_pylist() for c in ("part", "after", "s", "e")))]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("row"), b.column("no"), pa.array(ids, pa.binary())], names=["__id", "row", "no", "ids"])

    return run


def _collapse(key, data):
    def run(batches):
        model = loaded(key, data.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("row"), pa.array([_ids(model.collapsed(numbers(x))) for x in b.column("ids").to_pylist()], pa.binary())], names=["__id", "row", "ids"])

    return run


def encode(docs: DataFrame, model_file: str = MODEL, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, ids, extra) of every row; ids: little-endian 32-bit numbers as binary (see numbers()).

    extra: columns of EXTRA, made in the same pass over the rows: decoded text, ids as a list.

    The model file is read on the driver and sent along (its size is the public model's, under a megabyte).
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    with open(model_file, "rb") as f:
        raw = f.read()
    key, data = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = dict(src.dtypes)["__id"]
    giant = F.coalesce(F.length("__text") > chunk, F.lit(False))
    schema = ", ".join([f"__id {kind}, ids binary, __text string", *(f"{n} {EXTRA[n][0]}" for n in extra)])
    whole = src.where(~giant).mapInArrow(_with(extra)(key, data), schema)
    parts = src.where(giant).mapInArrow(_split(key, data, chunk), f"__id {kind}, row binary, no int, part string, after string").repartition("__id", "no")
    done = f"__id {kind}, row binary, no int, ids binary"
    at = ["__id", "row", "no"]
    if loaded(key, raw).unigram:
        parts = common.cut(parts, "chunks")
        m = parts.mapInArrow(_transfers(key, data), f"__id {kind}, row binary, no int, m array<double>")
        ms = m.groupBy("__id", "row").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("no", "m")))).alias("ms"))
        states = ms.mapInArrow(_states, f"__id {kind}, row binary, no int, s int, e int")
        same = F.lit(True)
        for c in at:
            same = same & parts[c].eqNullSafe(states[c])
        coded = parts.join(states, same).select(*(parts[c] for c in at), "part", "after", "s", "e").mapInArrow(_backtraces(key, data), done)
    else:
        coded = parts.mapInArrow(_encode_parts(key, data), done)
    # repeated rows of one id and text are alike, so one chunk of each number does, and copies come back by the join below
    joined = coded.groupBy("__id", "row").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("no", "ids")))).alias("c")).select("__id", "row", F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    if loaded(key, raw).unigram:
        joined = joined.mapInArrow(_collapse(key, data), f"__id {kind}, row binary, ids binary")
    back = src.where(giant).withColumn("row", F.substring(F.unhex(F.sha2(F.col("__text").cast("binary"), 256)), 1, 12)).alias("t")
    long = back.join(joined.alias("j"), F.col("t.__id").eqNullSafe(F.col("j.__id")) & (F.col("t.row") == F.col("j.row"))).select("t.__id", "j.ids", "t.__text")
    if extra:
        long = long.mapInArrow(_with(extra)(key, data), schema)
    return whole.unionByName(long).select(F.col("__id").alias(id_col), F.col("__text").alias("text"), "ids", *extra)


def numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<i4").tolist()


def _decode(key, data):
    def run(batches):
        model = loaded(key, data.value)
        for b in batches:
            text = [model.lib.decode(numbers(x)) for x in b.column("ids").to_pylist()]
            cols = [b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(text, pa.string())], names=[*b.schema.names, "decoded"])

    return run


def decode(coded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """coded (with a column ids, as encode() gives it) and decoded, the text that the ids stand for."""
    spark = coded.sparkSession
    with open(model_file, "rb") as f:
        raw = f.read()
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields if f.name != "decoded")
    return coded.drop("decoded").mapInArrow(_decode(hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)), f"{types}, decoded string")


def digest(docs: DataFrame) -> DataFrame:
    got = encode(docs, extra=("decoded",))
    return got.select("doc_id", F.length("text").cast("long").alias("n_chars"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("lossless"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256, lossless over whole documents."""
    return digest(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, n_tokens and ids (array) of every document."""
    return encode(docs, extra=("list",)).select("doc_id", F.size("list").cast("long").alias("n_tokens"), F.col("list").alias("ids"))
