"""Best-fit packing of documents into sequences under several capacities.

Documents are tokenized where they lie; only one longer than a sequence is cut, its first piece
being the shorter one. Every piece gets a hash-random shard of about `shard_pieces`, drawn with its
row's number in the stored table, so that rows alike are dealt over all shards. A shard is packed by
itself, longest piece first: among the open sequences whose residual tokens, documents and attention
cost all hold the piece, the one with the least weighted norm of the residuals that would be left
takes it. A shard leaves a few sequences unfilled out of thousands.

The attention cost of a piece is the square of its length in whole tiles of TILE tokens, as attention
kernels compute it, so many short pieces cost more than the square of their tokens. A sequence may
hold `max_docs` pieces and a cost of `max_cost`. By default these are a piece a token and a tile more
than the longest piece has, which no sequence of `capacity` tokens exceeds: op6_packing has to give the
fewest sequences by tokens alone. Lower limits bind, as in the pipeline.

Defined cases: a null text is an empty document and holds the end id alone. Repeated rows are
separate documents. With no rows there are no pieces. Of sequences whose residuals tie the one opened
first (in the order of the open ones) takes the piece; pieces of one length go by doc_id, piece and
checksum. A very long text is tokenized whole in its task and cut into pieces of a sequence each.
Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, ship, spread
from tracewell.llm.tokenizing import memory

LENGTH = 1024
SHARD_PIECES = 8192
TILE = 16
#: Weights of the residual tokens, documents and cost, each as a share of its capacity.
WEIGHTS = (1.0, 0.1, 0.1)


def pieces(docs: DataFrame, vocab: str, end_id: int, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit) of every piece of docs."""
    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = memory(vocab), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some, out = batch.slice(lo, 256), []
                for name, raw in zip(some.column("doc_id").to_pylist(), known.encode(some.column("text").to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    first = (n - 1) % length + 1
                    cuts = [0, *range(first, n + 1, length)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        ids = raw[4 * a : 4 * b]
                        out.append((name, k, a, b - a, zlib.crc32(ids), ids)[: 5 + with_ids])
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names=names[: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).transform(spread).mapInArrow(work, schema)


def cost_of(lengths):
    """The attention cost of pieces, in squared tiles."""
    return (-(-lengths // TILE)) ** 2


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and offset of each piece; lengths must not increase."""
    n = len(lengths)
    seq, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    caps = np.array([capacity, max_docs, max_cost], dtype=float)
    scale = np.asarray(weights) / caps**2
    left = np.empty((3, n))  # of open sequences: tokens, documents, attention cost
    names = np.empty(n, np.int64)
    opened = used = 0
    costs = cost_of(lengths)
    least, least_cost = (lengths[-1], costs[-1]) if n else (0, 0)
    for i, (size, cost) in enumerate(zip(lengths.tolist(), costs.tolist(), strict=True)):
        if size > capacity or cost > max_cost or max_docs < 1:
            raise ValueError("a piece exceeds a sequence's capacity")
        view = left[:, :opened]
        fits = np.flatnonzero((view[0] >= size) & (view[1] >= 1) & (view[2] >= cost)) if opened else ()
        if len(fits):
            some = view[:, fits]
            norm = scale[0] * (some[0] - size) ** 2 + scale[1] * (some[1] - 1) ** 2 + scale[2] * (some[2] - cost) ** 2
            k = fits[int(norm.argmin())]
        else:
            k, opened = opened, opened + 1
            left[:, k], names[k] = caps, used
            used += 1
        seq[i], offset[i] = names[k], capacity - left[0, k]
        left[:, k] -= (size, 1, cost)
        if left[0, k] < least or left[1, k] < 1 or left[2, k] < least_cost:  # nothing more fits: the last open one takes its place
            opened -= 1
            left[:, k], names[k] = left[:, opened], names[opened]
    return seq, offset


def pack(cut_pieces: DataFrame, capacity: int = LENGTH, max_docs: int | None = None, max_cost: int | None = None, shard_pieces: int = SHARD_PIECES, weights=WEIGHTS) -> DataFrame:
    """cut_pieces (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset. Its rows are counted and numbered first, so they must be stored."""
    max_docs = capacity if max_docs is None else max_docs
    max_cost = int(cost_of(capacity + TILE)) if max_cost is None else max_cost
    shards = max(1, -(-cut_pieces.count() // shard_pieces))
    columns = cut_pieces.columns
    sharded = cut_pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        seq, offset = best_fit(rows["length"].to_numpy(np.int64), capacity, max_docs, max_cost, weights)
        return rows.assign(sequence_id=(int(rows["_shard"].iloc[0]) << 32) + seq, offset=offset)[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"`{c}` {t}" for c, t in cut_pieces.dtypes) + ", sequence_id long, offset long"
    return sharded.groupBy("_shard").applyInPandas(work, schema)


def run(docs: DataFrame, vocab: str, end_id: int, capacity: int = LENGTH, **limits) -> DataFrame:
    """The pieces of docs with their places; pieces without ids, some tens of bytes each, are checkpointed."""
    return pack(cut(pieces(docs, vocab, end_id, capacity)), capacity, **limits)
