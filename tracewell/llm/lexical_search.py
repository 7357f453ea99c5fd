"""Ranked lexical search by block-max pruning, in integers.

An index of a batch of queries is built over all documents, in two stored passes:

1. Texts are folded and counted once. Up to BLOCK_DOCS documents that lie together make a block,
   which keeps each document's size and, for the terms that the batch asks for, how often it has
   them (the forward index). From these come N, L and every term's df.
2. A term's impact in a document, (10^9 * tf) div (1000 * tf + 12 * m), does not depend on the
   query; each block gets the largest impact of each of its terms.

A query's bound for a block is the sum of weight * largest impact over the query's terms. First
the SEED_BLOCKS blocks with the greatest bounds are scored, for each query; the score of the k-th
document is a threshold. Then every task takes its blocks by descending bound and scores them from
the forward index until the bound falls below the threshold, which rises with what is found. A
bound equal to the threshold is still scored, so ties are kept. Bounds, impacts and scores are
64-bit integers, so nothing is lost by rounding. Scoring one block is a table look-up per posting.

Sizes: only the batch's terms and weights are broadcast, about BATCH_WORDS words of BATCH_QUERIES queries; more
queries make more batches, each with an index of its own. A task holds one Arrow batch of blocks.
A task passes on k documents a query, the last step ranks those.

Defined cases: a null or empty text has no terms and is found by no query; a query without terms
finds nothing. Each row of the queries is a query; rows with the same item_id are ranked on their
own. Repeated documents are separate rows; equal scores go by doc_id, null last. Very long texts
count whole. Empty tables give no rows. Other columns may have any names; they are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import cut, remove, shared_dir, ship, spread
from tracewell.llm.folded import fold, sql_words, words

K = 20
BLOCK_DOCS = 64
SEED_BLOCKS = 4
BATCH_WORDS, BATCH_QUERIES = 1_000_000, 10_000
#: Blocks that a task sorts by bound at once.
SORTED_BLOCKS = 512
_BLOCK = "block long, doc_ids array<long>, sizes array<long>, starts array<int>, terms array<int>, tfs array<int>, held array<int>, dfs array<int>"
_HITS = "query int, doc_id long, score long"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def _count(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of sizes and term counts; `held` and `dfs` say how many documents of a block have a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, seq = sent.value, TaskContext.get().partitionId(), 0
        names, sizes, terms, tfs = [], [], [], []

        def block() -> pa.RecordBatch:
            held, dfs = np.unique(np.concatenate(terms), return_counts=True)
            starts = np.cumsum([0, *map(len, terms)])
            cells = [[(task << 32) + seq], [names], [sizes], [starts], [np.concatenate(terms)], [np.concatenate(tfs)], [held], [dfs]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for name, raw in zip(batch.column("doc_id"), batch.column("_raw"), strict=True):
                found = fold(raw.as_py()).split()
                known, times = np.unique(np.fromiter((k for k in map(ids.get, found) if k is not None), np.int32), return_counts=True)
                names.append(name.as_py()), sizes.append(len(found)), terms.append(known), tfs.append(times.astype(np.int32))
                if len(names) == BLOCK_DOCS:
                    yield block()
                    seq, names, sizes, terms, tfs = seq + 1, [], [], [], []
        if names:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_raw"))
    return spread(rows).mapInArrow(work, _BLOCK)


def impacts(tfs: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """The impact of counts in documents of these sizes, among n documents of `total` terms."""
    m = 75 + (25 * sizes * n) // max(total, 1)
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * m)


def _with_maxima(blocks: DataFrame, n: int, total: int) -> DataFrame:
    """The blocks with impacts in place of counts, and each term's largest one, in the order of `held`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, most = [], []
            for k in range(batch.num_rows):
                starts, sizes, terms, tfs, held = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in ("starts", "sizes", "terms", "tfs", "held"))
                x = impacts(tfs, np.repeat(sizes, np.diff(starts)), n, total)
                top = np.zeros(len(held), np.int64)
                np.maximum.at(top, np.searchsorted(held, terms), x)
                found.append(x.astype(np.int32)), most.append(top.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "doc_ids", "starts", "terms", "held")), _lists(found, pa.int32()), _lists(most, pa.int32())], names=["block", "doc_ids", "starts", "terms", "held", "impacts", "maxima"])

    return blocks.drop("dfs").mapInArrow(work, "block long, doc_ids array<long>, starts array<int>, terms array<int>, held array<int>, impacts array<int>, maxima array<int>")


class Queries:
    """Weighted terms of a batch of queries, by query and by term."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n_queries: int, n_terms: int):
        self.n, self.n_terms = n_queries, n_terms
        by = np.argsort(query, kind="stable")
        self.terms, self.weights, self.starts = term[by], weight[by], np.searchsorted(query[by], np.arange(n_queries + 1))
        by = np.argsort(term, kind="stable")
        self.q_of, self.w_of, self.first = query[by], weight[by], np.searchsorted(term[by], np.arange(n_terms + 1))

    def bounds(self, held: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        """The greatest score that each query could have in a block."""
        lo, size = self.first[held], self.first[held + 1] - self.first[held]
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.q_of[at], self.w_of[at] * np.repeat(maxima, size))
        return out

    def scores(self, q: int, table: np.ndarray, starts: np.ndarray, terms: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The scores of a block's documents; `table` is zeros, one a term, and is so again afterwards."""
        mine = self.terms[self.starts[q] : self.starts[q + 1]]
        table[mine] = self.weights[self.starts[q] : self.starts[q + 1]]
        sums = np.concatenate([[0], np.cumsum(table[terms] * found)])
        table[mine] = 0
        return sums[starts[1:]] - sums[starts[:-1]]


class Best:
    """The k best documents of a query so far: highest score, then least doc_id, null last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.rows = k, floor, []

    def add(self, doc_ids: list, scores: np.ndarray) -> None:
        for at in np.flatnonzero(scores >= max(self.floor, 1)):
            self.rows.append((-int(scores[at]), doc_ids[at] is None, doc_ids[at] or 0))
        if len(self.rows) > self.k:
            self.rows = sorted(self.rows)[: self.k]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, -max(self.rows)[0])


def _seeds(index: DataFrame, queries, most: int) -> DataFrame:
    """query, block, bound: the `most` blocks with the greatest bounds of each query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        top, where = np.zeros((most, asked.n), np.int64), np.zeros((most, asked.n), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                bound = asked.bounds(batch.column("held")[k].values.to_numpy(), batch.column("maxima")[k].values.to_numpy().astype(np.int64))
                least, all_ = top.argmin(0), np.arange(asked.n)
                better = all_[bound > top[least, all_]]
                top[least[better], better], where[least[better], better] = bound[better], batch.column("block")[k].as_py()
        rank, q = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(where[rank, q], pa.int64()), pa.array(top[rank, q], pa.int64())], names=["query", "block", "bound"])

    found = index.select("block", "held", "maxima").mapInArrow(work, "query int, block long, bound long")
    by = W.partitionBy("query").orderBy(F.col("bound").desc(), "block")
    return found.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= most).drop("_rank")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    by = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _scored(index: DataFrame, queries, floors, k: int, asks: dict[int, list[int]] | None = None) -> DataFrame:
    """The k best documents of each query in each task, of blocks whose bound reaches the query's threshold; of those in `asks` alone, where given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = queries.value, floors.value
        table, best = np.zeros(asked.n_terms, np.int64), [Best(k, int(f)) for f in floor]
        for batch in batches:
            for lo in range(0, batch.num_rows, SORTED_BLOCKS):
                some = batch.slice(lo, SORTED_BLOCKS)
                columns = {c: [x.values.to_numpy() for x in some.column(c)] for c in ("starts", "terms", "impacts", "held", "maxima")}
                names = [x.as_py() for x in some.column("doc_ids")]
                bound = np.stack([asked.bounds(h, m.astype(np.int64)) for h, m in zip(columns["held"], columns["maxima"], strict=True)])
                if asks is not None:
                    wanted = np.zeros(bound.shape, bool)
                    for b, block in enumerate(some.column("block").to_pylist()):
                        wanted[b, asks[block]] = True
                    bound = np.where(wanted, bound, 0)
                order = np.argsort(-bound, axis=0, kind="stable")
                for q in np.flatnonzero(bound.max(0) > 0):
                    for b in order[:, q]:
                        if bound[b, q] < max(best[q].floor, 1):
                            break
                        best[q].add(names[b], asked.scores(q, table, columns["starts"][b], columns["terms"][b], columns["impacts"][b]))
        rows = [(q, None if null else name, -score) for q, x in enumerate(best) for score, null, name in x.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    if asks is not None:
        index = index.where(F.col("block").isin(list(asks)))
    return index.mapInArrow(work, _HITS)


def _search(docs: DataFrame, terms: list, kind: str, k: int) -> DataFrame:
    """item_id, rank, doc_id and score of one batch of queries: rows (row, item_id, term, n), item_id of this type."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    vocabulary: dict[bytes, int] = {}
    term = np.array([vocabulary.setdefault(r.term.encode(), len(vocabulary)) for r in terms], np.int64)
    numbers: dict[int, int] = {}
    query = np.array([numbers.setdefault(r.row, len(numbers)) for r in terms], np.int64)
    items = dict(zip(query.tolist(), (r.item_id for r in terms), strict=True))
    counted, path = shared_dir(spark, "search-counts"), shared_dir(spark, "search-index")
    _count(docs, vocabulary).write.parquet(counted)
    blocks = spark.read.parquet(counted)
    total, n = blocks.select(F.explode("sizes").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in blocks.select(F.explode(F.arrays_zip("held", "dfs")).alias("x")).groupBy("x.held").agg(F.sum("x.dfs").alias("df")).collect():
        df[r.held] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    asked = Queries(query, term, weight[term] * np.array([r.n for r in terms], np.int64), len(items), len(vocabulary))
    _with_maxima(blocks, n, total).write.parquet(path)
    remove(spark, counted)
    index, sent = spark.read.parquet(path), sc.broadcast(asked)
    asks: dict[int, list[int]] = {}
    for r in _seeds(index, sent, SEED_BLOCKS).collect():
        asks.setdefault(r.block, []).append(r.query)
    floors = np.zeros(asked.n, np.int64)
    if asks:
        for r in _ranked(_scored(index, sent, sc.broadcast(floors), k, asks), k).where(F.col("rank") == k).collect():
            floors[r.query] = r.score
    names = F.broadcast(spark.createDataFrame(list(items.items()), f"query int, item_id {kind}"))
    found = cut(_ranked(_scored(index, sent, sc.broadcast(floors), k), k))
    remove(spark, path)
    return found.join(names, "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = K, batch_words: int = BATCH_WORDS, batch_queries: int = BATCH_QUERIES) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents (doc_id, text) of each row of queries (item_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    kind = queries.schema["item_id"].dataType.simpleString()
    asked = queries.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    asked = cut(asked.withColumn("row", F.monotonically_increasing_id()))
    n_words, n_queries = asked.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, math.ceil(n_words / batch_words), math.ceil(n_queries / batch_queries))
    out = None
    for b in range(n):
        batch = asked.where(F.pmod(F.xxhash64("row"), F.lit(n)) == b)
        terms = batch.select("row", "item_id", F.explode("w").alias("term")).groupBy("row", "item_id", "term").agg(F.count(F.lit(1)).alias("n"))
        terms = terms.collect()
        if terms:
            found = _search(docs, terms, kind, k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def oracle(k: int = K) -> str:
    return f"""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents),
    item AS (SELECT row_number() OVER () AS q, item_id, {sql_words('text')} AS w FROM benchmark),
    corpus AS (SELECT count(*) AS n, sum(len(w)) AS l FROM doc WHERE len(w) > 0),
    tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM doc) GROUP BY ALL),
    weight AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
    ask AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM item) GROUP BY ALL),
    size AS (SELECT r, doc_id, CAST(75 + (25 * len(w) * n) // l AS BIGINT) AS m FROM doc, corpus),
    score AS (
        SELECT q, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
        FROM ask JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (r) GROUP BY ALL
    ),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= {k}
    """
