"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the benchmark's items.

Texts are folded to words of letters and digits. A pattern is a window of ten consecutive words of
an item, or a shorter item as a whole. A word of the patterns is one symbol of the automaton, any
other word the symbol that no pattern has, so a text is scanned once, word by word, whatever the
number of items, and an occurrence ends at a word whose place in the original text is known.

The patterns are broadcast: up to PATTERN_BYTES of them (words and item ids) make one automaton. A
larger benchmark is dealt by hash over as many automata of that size as it needs, each with a scan
of its own; what they find is one row a different text and automaton, and joined by the text. No
row is shuffled in the first case, and only the keys of texts that were hit in the second.

Defined cases: a null or empty text has no words and no hits; an item without words has no windows.
A null item_id is written as an empty string. Rows of the benchmark with one item_id are one item.
Repeated documents are separate rows with the same result; repeated items count once. Very long
texts are scanned whole. An empty benchmark hits nothing, an empty table gives no rows. Other
columns may have any names; they are left out of the result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, join_small, ship, spread
from tracewell.llm.folded import fold, offsets, sql_words, words

WINDOW = 10
#: What the patterns of one automaton may take as text.
PATTERN_BYTES = 8 << 20
SLICE = 256
_UNKNOWN = "\0"
_FOUND = "n_words long, n_hit long, items array<string>, _words array<long>, spans array<struct<begin:long,end:long>>"


class Vocabulary(dict):
    """Word to symbol; words that no pattern has share one."""

    def __missing__(self, word: bytes) -> str:
        return _UNKNOWN


class Automaton:
    """The automaton of (pattern, item) pairs; a pattern is words joined by spaces."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.symbols, self.patterns, self.items = Vocabulary(), ahocorasick.Automaton(), {}
        for pattern, item in pairs:
            key = "".join(self.symbols.setdefault(w, chr(len(self.symbols) + 1)) for w in pattern.encode().split())
            self.items.setdefault(key, set()).add(item)
        for key in self.items:
            self.patterns.add_word(key, key)
        self.patterns.make_automaton()

    def find(self, folded_words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Runs of hit words, as rows (first, last), and the items whose windows occur."""
        if not self.items:
            return np.zeros((0, 2), np.int64), []
        runs, found = [], set()
        for last, key in self.patterns.iter("".join(map(self.symbols.__getitem__, folded_words))):
            first = last - len(key) + 1
            found.add(key)
            while runs and first <= runs[-1][0]:  # a longer pattern takes in what ended before
                runs.pop()
            if runs and first <= runs[-1][1] + 1:
                runs[-1] = (runs[-1][0], last)
            else:
                runs.append((first, last))
        return np.array(runs, np.int64).reshape(-1, 2), sorted(set().union(*(self.items[k] for k in found)))


_built: dict[str, Automaton] = {}


def _automaton(name: str, sent) -> Automaton:
    """The automaton of a broadcast by its name, built once by a worker; the one before is given up."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(sent.value)
    return _built[name]


def patterns(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Different (pattern, item) pairs of the items (item_id, text)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return items.withColumn("at", F.explode(starts)).select(F.concat_ws(" ", F.slice("w", F.col("at") + 1, window)).alias("pattern"), "item").distinct()


def _scan(docs: DataFrame, pairs: list[tuple[str, str]], kept: list[str], hits_only: bool) -> DataFrame:
    """Columns `kept` of docs, which has the text as raw bytes in _raw, with what one automaton finds."""
    sent, name = docs.sparkSession.sparkContext.broadcast(pairs), uuid.uuid4().hex
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _automaton(name, sent)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                rows, sizes, hits, items, places, spans = [], [], [], [], [], []
                for k, raw in enumerate(some.column("_raw")):
                    folded = fold(raw.as_py())
                    found = folded.split()
                    runs, names = known.find(found)
                    if hits_only and not len(runs):
                        continue
                    rows.append(k), sizes.append(len(found)), items.append(names), places.append(runs.ravel())
                    hits.append(int((runs[:, 1] - runs[:, 0] + 1).sum()))
                    spans.append([{"begin": a, "end": b} for a, b in zip(*(x.tolist() for x in offsets(folded, *runs.T)), strict=True)] if len(runs) else [])
                arrays = [some.column(c).take(pa.array(rows, pa.int32())) for c in kept]
                arrays += [pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int64())), pa.array(spans, spans_type)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "n_words", "n_hit", "items", "_words", "spans"])

    types = dict(docs.dtypes)
    return docs.select(*kept, "_raw").mapInArrow(work, ", ".join(f"{c} {types[c]}" for c in kept) + ", " + _FOUND)


def _united(parts: list) -> tuple:
    """What several automata found in one text, as n_hit, items, spans."""
    runs = sorted((a, b, s["begin"], s["end"]) for words_, _, spans in parts for a, b, s in zip(words_[::2], words_[1::2], spans, strict=True))
    out: list[list[int]] = []
    for a, b, begin, end in runs:
        if out and a <= out[-1][1] + 1:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, end
        else:
            out.append([a, b, begin, end])
    return sum(b - a + 1 for a, b, _, _ in out), sorted({i for _, items, _ in parts for i in items}), [(begin, end) for _, _, begin, end in out]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted) and spans of hit text, in code points of the original, of every document (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    pairs = cut(patterns(benchmark, window))
    size = pairs.agg(F.sum(F.octet_length("pattern") + F.octet_length("item") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / pattern_bytes))
    dealt = pairs.withColumn("k", F.pmod(F.xxhash64("pattern", "item"), F.lit(n)))

    def part(k: int) -> list[tuple[str, str]]:
        return [(r.pattern, r.item) for r in dealt.where(F.col("k") == k).select("pattern", "item").collect()]

    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [F.xxhash64(text, F.lit(7)).alias("_t1"), F.xxhash64(F.lit(8), text).alias("_t2"), F.octet_length(text).alias("_t3")] if n > 1 else []
    names = [f"_t{k}" for k in (1, 2, 3)][: len(keys)]
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, text.cast("binary").alias("_raw")))
    first = _scan(rows, part(0), ["doc_id", *names], False)
    if n == 1:
        return first.drop("_words")

    @F.udf("n_hit long, items array<string>, spans array<struct<begin:long,end:long>>")
    def unite(parts):
        return _united([(p["_words"], p["items"], p["spans"]) for p in parts])

    # One row a different text and automaton: repeated texts are dropped before rows meet, so a text has at most n.
    found = _scan(rows, part(0), names, True).withColumn("_k", F.lit(0))
    for k in range(1, n):
        found = found.unionByName(_scan(rows, part(k), names, True).withColumn("_k", F.lit(k)))
    found = found.dropDuplicates([*names, "_k"]).groupBy(*names).agg(F.collect_list(F.struct("_words", "items", "spans")).alias("_parts"))
    found = cut(found.select(*names, unite("_parts").alias("_u")))
    both = join_small(first.select("doc_id", "n_words", *names), found, names, "left")
    return both.select("doc_id", "n_words", F.coalesce("_u.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("_u.items", F.array().cast("array<string>")).alias("items"), F.coalesce("_u.spans", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans"))


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of find()."""
    found = find(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest(items: list[str]) -> str:
    """What items_sha256 says of sorted items."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def oracle(window: int = WINDOW) -> str:
    return f"""
    WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {sql_words('text')} AS w FROM benchmark),
    pattern AS (
        SELECT DISTINCT item, least(len(w), {window}) AS size, array_to_string(w[place + 1 : place + {window}], ' ') AS p
        FROM (SELECT item, w, unnest(range(0, greatest(len(w) - {window}, 0) + 1)) AS place FROM item WHERE len(w) > 0)
    ),
    doc AS (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents),
    gram AS (
        SELECT r, size, place, array_to_string(w[place + 1 : place + size], ' ') AS p
        FROM (SELECT r, w, size, unnest(range(0, len(w) - size + 1)) AS place FROM doc, (SELECT DISTINCT size FROM pattern) WHERE len(w) >= size)
    ),
    hit AS (SELECT r, place, pattern.size, item FROM gram JOIN pattern USING (size, p)),
    words_hit AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT DISTINCT r, unnest(range(place, place + size)) AS word FROM (SELECT DISTINCT r, place, size FROM hit)) GROUP BY r),
    items_hit AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
    """
