"""Token ids in fixed-width bit-packed files.

An image holds some documents in order: a header, document ids, document starts, block offsets,
and blocks of 4096 ids, each id in the fewest bits that hold the vocabulary. 64 ids fill as
many 64-bit words as an id has bits, so packing and unpacking are 64 steps of numpy over all
groups, and any document is read from its own blocks alone. Images are binary rows of Parquet
written by Spark, so that any store Spark writes to can hold them.

Documents are dealt out by ranges of doc_id (then of the text's hash, so that rows of one id
spread), tokenized where they lie, and cut into images of about `image_ids` ids. What precedes
an image is a prefix sum over images within a range and over ranges.

Defined cases: a null text is an empty one and holds the end id alone; a null doc_id comes
first; rows of one doc_id are in the order of their texts' hashes. Repeated rows, which tie, are dealt
at random over the ranges of their place, so that they are no hot key. A very long text is encoded
whole in its task. An empty table gives no rows; columns besides doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import shared_dir, ship
from tracewell.llm.tokenizing import memory

MAGIC = b"TWPK0001"
BLOCK = 4096
IMAGE_IDS = 1 << 20
HEAD = struct.Struct("<8sIIQQ")
BROADCAST_IMAGES = 500_000


def bits_for(size: int) -> int:
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in groups of 64, each in `bits` 64-bit words; the last group is filled with zeros."""
    v = np.zeros((-(-len(ids) // 64), 64), dtype=np.uint64)
    v.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(v), bits), dtype="<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    words = np.frombuffer(raw, dtype="<u8").reshape(-1, bits)
    out, mask = np.empty((len(words), 64), dtype=np.uint64), np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = v & mask
    return out.reshape(-1)[:n].astype("<u4")


def image(doc_ids: list[int | None], docs: list[np.ndarray], bits: int) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u8")
    blocks = [pack(ids[k : k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    null = np.array([d is None for d in doc_ids], dtype="u1")
    return b"".join([HEAD.pack(MAGIC, bits, BLOCK, len(docs), len(ids)), names.tobytes(), null.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Image:
    """Reads an image; read(a, b) unpacks only the blocks that hold ids a to b."""

    def __init__(self, raw: bytes):
        magic, self.bits, self.block, n, self.n_ids = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token image")
        at = HEAD.size
        names, at = np.frombuffer(raw, "<i8", n, at), at + 8 * n
        null, at = np.frombuffer(raw, "u1", n, at), at + n
        self.doc_ids = [None if z else int(x) for x, z in zip(names, null, strict=True)]
        self.starts, at = np.frombuffer(raw, "<u8", n + 1, at).astype(np.int64), at + 8 * (n + 1)
        count = -(-self.n_ids // self.block)
        self.offsets, self.at = np.frombuffer(raw, "<u8", count + 1, at).astype(np.int64), at + 8 * (count + 1)
        self.raw = raw

    def read(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, "<u4")
        first, last = a // self.block, (b - 1) // self.block
        raw = self.raw[self.at + self.offsets[first] : self.at + self.offsets[last + 1]]
        base = first * self.block
        return unpack(raw, self.bits, min(self.n_ids, (last + 1) * self.block) - base)[a - base : b - base]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, vocab: str, end_id: int, path: str, image_ids: int = IMAGE_IDS) -> None:
    """Tokenize docs (doc_id, text) and write their images, in ascending order of doc_id, under path."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("_any", F.rand(5))
    parts = max(1, rows.rdd.getNumPartitions())
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "_h", "_any").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h", "_any")

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory(vocab)
        bits = bits_for(max(known.tokenizer.get_vocab_size(), end_id + 1))
        part, seq, names, docs_, size = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def flush():
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(names)], "n_tokens": [size], "image": [image(names, docs_, bits)]}, schema=schema)

        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                for name, raw in zip(some.column("doc_id").to_pylist(), known.encode(some.column("text").to_pylist()), strict=True):
                    names.append(name)
                    docs_.append(np.frombuffer(raw + end, "<u4"))
                    size += len(docs_[-1])
                    if size >= image_ids:
                        yield flush()
                        seq, names, docs_, size = seq + 1, [], [], 0
        if names:
            yield flush()

    rows.select("doc_id", "text").mapInArrow(images, "part long, seq long, n_docs long, n_tokens long, image binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian 32-bit) of every document in the files under path."""
    ship(spark)
    files = spark.read.parquet(path)
    sizes = files.select("part", "seq", "n_tokens")
    ranges = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    ranges = ranges.select("part", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_range"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ranges, "part").select("part", "seq", (F.col("_in") + F.col("_range")).alias("_start"))
    placed = files.join(F.broadcast(starts) if sizes.count() <= BROADCAST_IMAGES else starts, ["part", "seq"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, raw in zip(batch.column("_start").to_pylist(), batch.column("image"), strict=True):
                held = Image(raw.as_py())
                for lo in range(0, len(held.doc_ids), 256):
                    hi = min(lo + 256, len(held.doc_ids))
                    a = int(held.starts[lo])
                    ids = held.read(a, int(held.starts[hi]))
                    each = [ids[int(held.starts[k]) - a : int(held.starts[k + 1]) - a].tobytes() for k in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(held.doc_ids[lo:hi], pa.int64()), pa.array(held.starts[lo:hi] + base, pa.int64()), pa.array([len(x) // 4 for x in each], pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return placed.select("_start", "image").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, vocab: str, end_id: int) -> DataFrame:
    spark = docs.sparkSession
    path = shared_dir(spark, "token-files")
    write(docs, vocab, end_id, path)
    return read(spark, path)
