"""Language-model scores by a weighted backoff automaton over words.

Smoothed trigrams are the automaton. Its states are the histories seen in training: the root, which
is no history, one word, and two words; a document begins in the state of the beginning. An arc
leads from a history h over a word w seen after it to the longest history that ends hw; a failure
arc leads to h without its first word. With c counts of training tokens, N all of them, V the
distinct ones, n1 and n2 the words seen once and twice, D = (n1 + 1) / (n1 + 2 n2 + 2) and
l(h) = LAMBDA c(h) / (c(h) + EVIDENCE), the weights are logarithms of

    root arc     p(w) = (c(w) - D) / N; all words not seen share D V / N
    arc          p(w | h) = l(h) c(h, w) / c(h) + (1 - l(h)) p(w | h without its first word)
    failure arc  1 - l(h)

which sum to 1 over V words and one unknown. A text is traversed once, left to right: the state
is carried, an arc that it lacks is sought along its failure arcs, and weights are added up.
Texts lie one after the other in lanes of equal length that are traversed side by side; a lane
that begins inside a text reads the two tokens before it first, which fix the state.

No model is held whole anywhere. Documents are dealt where they lie into blocks of about
BLOCK_BYTES. A block sends the hashes of its n-grams, sorted and delta-coded, with its own training
counts, by hash range to buckets; a bucket adds up the counts of all blocks and answers each with
the totals of what it asked, in its order. The block's texts, compressed, go the same way, so that
they are read once; with the totals they have the part of the automaton that they can reach. Beyond
FAN blocks, blocks go in groups of FAN: a group's n-grams are first added up by coarse ranges, and
these sums ask the buckets, so that messages grow by blocks * buckets / FAN and stay whole.
Words are named by 64 bits, longer n-grams by the bits that leave fewer than one in 2 ** 16 of
them a name in common.

Defined cases: a null text is an empty one and has the end token alone. Repeated rows count as
often as they occur. With no training rows N = V = 0: every base term is log10(1) = 0 and every
score is 0. A very long text is a block of its own, whole. Ties do not occur; an empty table gives no
rows; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import crc_rest, ship, spread, words

BLOCK_BYTES = 5 << 20
BUCKET_BYTES = 10 << 20
FAN = 256
LANE = 256
LAMBDA = 0.4
EVIDENCE = 10.0
_WORDS = re.compile(rb"[^ \t-\r]+").findall
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Hashes of what is no word: the end of a text, and its beginning as a history.
END_KEY, BEGIN_KEY = np.uint64(1), np.uint64(2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def name_bits(n: int) -> int:
    """Bits of an n-gram's name, for n training tokens: at most one name in 2 ** 16 is shared."""
    return min(64, max(44, n.bit_length() + 16))


class Block:
    """The tokens of some texts, and their n-grams as places in sorted lists of names."""

    def __init__(self, hashes: np.ndarray, token: np.ndarray, sizes: np.ndarray, bits: int):
        """hashes of the words, then of end and begin; tokens as numbers of words, each text closed by the end; texts' sizes."""
        self.hashes, self.token, self.sizes = hashes, token, sizes
        self.end, self.begin = len(hashes) - 2, len(hashes) - 1
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first] = self.begin
        self.before = before
        drop = np.uint64(64 - bits)
        self.pairs, self.pair = np.unique(before.astype(np.int64) * len(hashes) + token, return_inverse=True)
        names = _mix(hashes[self.pairs // len(hashes)] * _MIX[0] + _mix(hashes[self.pairs % len(hashes)] + _MIX[0]))
        inside = np.ones(len(token), bool)
        inside[self.first] = False  # a text's first token has one token of history, its beginning
        self.at = np.flatnonzero(inside)
        last = self.pair[self.at - 1].astype(np.int64)  # the history of two, itself a pair
        self.triples, triple = np.unique(last * len(hashes) + token[self.at], return_inverse=True)
        names3 = _mix(names[self.triples // len(hashes)] * _MIX[1] + _mix(hashes[self.triples % len(hashes)] + _MIX[1]))
        self.triple = np.full(len(token), -1, np.int64)
        self.triple[self.at] = triple
        self.tail = np.zeros(len(self.triples), np.int64)  # the pair that ends a triple
        self.tail[triple] = self.pair[self.at]
        kinds = (hashes[:-1], (names >> drop) << drop, (names3 >> drop) << drop)
        self.keys, self.places = zip(*(np.unique(k, return_inverse=True) for k in kinds), strict=True)

    @classmethod
    def of(cls, texts: list[bytes], bits: int) -> Block:
        names: dict[bytes, int] = defaultdict(count().__next__)  # a new word takes the next number
        each = [list(map(names.__getitem__, _WORDS(t.lower()))) for t in texts]
        hashes = np.array([*map(xxhash.xxh3_64_intdigest, names), int(END_KEY), int(BEGIN_KEY)], dtype=np.uint64)
        sizes = np.array([len(x) + 1 for x in each], np.int64)
        for x in each:
            x.append(len(names))
        return cls(hashes, np.fromiter(chain.from_iterable(each), np.int64, int(sizes.sum())), sizes, bits)

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """Training counts of the block's words, pairs and triples, by their keys."""
        live = np.repeat(train, self.sizes)
        of = (self.token, self.pair, self.triple)
        return [np.bincount(p[o[live & (o >= 0)]], minlength=len(k)) for k, p, o in zip(self.keys, self.places, of, strict=True)]

    def base(self, words: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """Known tokens and base scores of the texts, from the totals of the words."""
        seen = words[self.token]
        return np.add.reduceat((seen > 0).astype(np.int64), self.first), np.add.reduceat(np.log10((seen + 1) / (n + v + 1)), self.first)


class Automaton:
    """The states, arcs and failure arcs that a block's texts can reach."""

    def __init__(self, block: Block, totals: list[np.ndarray], n: int, v: int, discount: float):
        w1, w2, w3 = (t[p].astype(float) for t, p in zip(totals, block.places, strict=True))
        size = len(block.hashes)
        seen = np.append(w1, w1[block.end])  # texts begin as often as they end
        # States: 0 the root, then histories of one word, then of two; those never seen in training are none.
        one, two = np.full(size, -1, np.int64), np.full(len(w2), -1, np.int64)
        h, w = block.pairs // size, block.pairs % size
        states1 = np.flatnonzero((seen > 0) & (np.arange(size) != block.end))
        states2 = np.flatnonzero((w2 > 0) & (w != block.end))
        one[states1] = 1 + np.arange(len(states1))
        two[states2] = 1 + len(states1) + np.arange(len(states2))
        held = np.concatenate([[1.0], seen[states1], w2[states2]])
        weight = LAMBDA * held / (held + EVIDENCE)
        self.order = np.repeat([0, 1, 2], [1, len(states1), len(states2)])
        self.fail = np.concatenate([[0], np.zeros(len(states1), np.int64), np.maximum(one[w[states2]], 0)])
        self.fail_weight = np.log10(1 - weight)
        self.fail_weight[0] = 0.0
        # Arcs, from the root, from one word and from two; -1 where there is none.
        p1 = np.where(w1 > 0, (w1 - discount) / n, discount * v / n)
        a2 = np.flatnonzero((w2 > 0) & (one[h] >= 0))
        l2 = weight[one[h[a2]]]
        p2 = np.zeros(len(w2))
        p2[a2] = l2 * np.minimum(1, w2[a2] / seen[h[a2]]) + (1 - l2) * p1[w[a2]]
        last = block.triples // size
        a3 = np.flatnonzero((w3 > 0) & (two[last] >= 0) & (p2[block.tail] > 0))
        l3, tail = weight[two[last[a3]]], block.tail[a3]
        p3 = l3 * np.minimum(1, w3[a3] / w2[last[a3]]) + (1 - l3) * p2[tail]
        arc2, arc3 = np.full(len(w2), -1, np.int64), np.full(len(w3), -1, np.int64)
        arc2[a2] = len(p1) + np.arange(len(a2))
        arc3[a3] = len(p1) + len(a2) + np.arange(len(a3))
        self.arc_weight = np.log10(np.concatenate([p1, p2[a2], p3]))
        to1 = np.maximum(one[: size - 1], 0)
        longest = np.where(two >= 0, two, np.append(to1, 0)[w])
        self.arc_to = np.concatenate([to1, longest[a2], longest[tail]])
        #: The state in which texts begin, and where every token's arcs are by the order of the state it is read in.
        self.begin = max(one[block.begin], 0)
        self.arcs = np.stack([block.token, arc2[block.pair], np.where(block.triple >= 0, arc3[block.triple], -1)])

    def traverse(self, first: np.ndarray) -> np.ndarray:
        """The weights met at each token; first marks tokens that begin a text."""
        n = self.arcs.shape[1]
        lanes = -(-n // LANE)
        begin = np.arange(lanes) * LANE
        state, out = np.zeros(lanes, np.int64), np.zeros(n)
        for step in range(-2, LANE):
            at = begin + step
            live = np.flatnonzero((at >= 0) & (at < n))
            at = at[live]
            now = np.where(first[at], self.begin, state[live])
            weight = np.zeros(len(at))
            while True:
                arc = self.arcs[self.order[now], at]
                lacks = np.flatnonzero(arc < 0)
                if not len(lacks):
                    break
                weight[lacks] += self.fail_weight[now[lacks]]
                now[lacks] = self.fail[now[lacks]]
            state[live] = self.arc_to[arc]
            if step >= 0:
                out[at] = weight + self.arc_weight[arc]
        return out


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes as the largest needs, all lowest bytes first, which compress better by themselves."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def totals(docs: DataFrame) -> tuple[int, int, int, int, int]:
    """Text bytes of all rows; N, V, n1 and n2 of the training rows. Words travel as hashes, pre-aggregated."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count_if("train").alias("d")).first()
    tokens = docs.where("train").select(F.explode(words(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).alias("w"))
    by_word = tokens.groupBy(F.xxhash64("w").alias("w")).agg(F.count(F.lit(1)).alias("c"))
    n = by_word.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
    ends = size.d
    return size.b or 0, (n.n or 0) + ends, n.v + (ends > 0), n.one + (ends == 1), n.two + (ends == 2)


def _keys(x: np.ndarray, bits: int) -> bytes:
    """Sorted names as their number, their first and the differences; the bits that all lack are not sent."""
    x = x >> np.uint64(64 - bits)
    return len(x).to_bytes(8, "little") + (int(x[0]).to_bytes(8, "little") + _narrow(np.diff(x)) if len(x) else b"")


def _read_keys(raw: bytes, bits: int) -> np.ndarray:
    if not int.from_bytes(raw[:8], "little"):
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw[8:16], "<u8"), _wide(raw[16:])]), dtype=np.uint64) << np.uint64(64 - bits)


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of names begins in sorted keys, and the end."""
    at = [-(-(k << 64) // n) for k in range(n)]
    return np.concatenate([np.searchsorted(keys, np.array(at, np.uint64)), [len(keys)]])


_ORDERS = range(3)


def _message(keys: list[np.ndarray], counts: list[np.ndarray], bits: int) -> tuple[bytes, bytes]:
    """Names of words, pairs and triples, and their counts, as two binaries."""
    named = [_keys(k, 64 if o == 0 else bits) for o, k in zip(_ORDERS, keys, strict=True)]
    return _joined(named), _joined([_narrow(c) for c in counts])


def _joined(parts: list[bytes], level: int = 1) -> bytes:
    return zlib.compress(b"".join(len(x).to_bytes(8, "little") + x for x in parts), level)


def _parts(raw: bytes) -> list[bytes]:
    raw, out, at = zlib.decompress(raw), [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _read(keys: bytes, counts: bytes, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [_read_keys(x, 64 if o == 0 else bits) for o, x in zip(_ORDERS, _parts(keys), strict=True)], [_wide(x).astype(np.int64) for x in _parts(counts)]


def _add(messages: list[tuple[list, list]]) -> tuple[list[np.ndarray], list[np.ndarray], list[list[np.ndarray]]]:
    """All names of some messages, their summed counts, and where each message's names are, by order."""
    keys, counts, places = [], [], []
    for o in _ORDERS:
        every, place = np.unique(np.concatenate([k[o] for k, _ in messages]), return_inverse=True)
        keys.append(every)
        counts.append(np.bincount(place, weights=np.concatenate([c[o] for _, c in messages]), minlength=len(every)).astype(np.int64))
        places.append(np.split(place, np.cumsum([len(k[o]) for k, _ in messages])[:-1]))
    return keys, counts, places


def _pack(texts: list[bytes], *more: bytes) -> bytes:
    sizes = _narrow(np.array([len(t) for t in texts], np.int64))
    return _joined([zstandard.compress(b"".join(texts), 6), sizes, *more], 0)  # the texts shrink no further


def _unpack(raw: bytes) -> tuple[list[bytes], list[bytes]]:
    joined, sizes, *more = _parts(raw)
    joined, ends = zstandard.decompress(joined), np.cumsum(_wide(sizes)).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)], more


_WIRE = "asker long, range long, target long, keys binary, counts binary, texts binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _WIRE.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _answers(rows: list[dict], bits: int) -> Iterator[tuple]:
    """The totals of a range's messages, back to who asked; what is no message goes on as it is."""
    asks = [r for r in rows if r["keys"] is not None]
    yield from (tuple(r.values()) for r in rows if r["keys"] is None)
    if asks:
        _, counts, places = _add([_read(r["keys"], r["counts"], bits) for r in asks])
        for k, r in enumerate(asks):
            yield r["asker"], r["range"], r["asker"], None, _joined([_narrow(counts[o][places[o][k]]) for o in _ORDERS]), None


def score(docs: DataFrame, mod: int = 7, held: int = 2, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), (crc_rest(F.col("doc_id"), mod) != held).alias("train"))
    rows = spread(rows)
    ship(docs.sparkSession)
    size, n, v, one, two = totals(rows)
    discount = (one + 1) / (one + 2 * two + 2)
    bits, buckets = name_bits(n), max(1, math.ceil(size / bucket_bytes))
    blocks = max(1, math.ceil(size / block_bytes))
    groups = math.ceil(blocks / fan)
    ranges = buckets if groups == 1 else min(buckets, fan)  # what a block sends to
    each = math.ceil(buckets / ranges)  # buckets of a coarse range

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            train, ids = t.column("train").to_numpy(), t.column("doc_id").combine_chunks()
            texts = t.column("text").cast(pa.binary()).to_pylist()
            b = Block.of(texts, bits)
            counts = b.counts(train)
            name = xxhash.xxh3_64_intdigest(f"{part} {made} ".encode() + b.hashes.tobytes() + b.token.tobytes()) - (1 << 63)
            group = name % groups
            cuts = [_ranges(k, ranges) for k in b.keys]
            out = []
            for r in range(ranges):
                some = [slice(c[r], c[r + 1]) for c in cuts]
                if any(x.stop > x.start for x in some):
                    out.append((name, r, group * ranges + r, *_message([k[x] for k, x in zip(b.keys, some, strict=True)], [c[x] for c, x in zip(counts, some, strict=True)], bits), None))
            out.append((name, -1, group * ranges + name % ranges, None, None, _pack(texts, train.tobytes(), np.asarray(ids.is_null()).tobytes(), ids.fill_null(0).to_numpy().tobytes())))
            held.clear()
            return _batch(out)

        room = block_bytes
        for batch in batches:
            sizes, lo = np.asarray(pc.binary_length(batch.column("text"))).tolist(), 0
            for hi, size in enumerate(sizes):
                if size > room and (held or hi > lo):  # the block is full
                    held += [batch.slice(lo, hi - lo)] * (hi > lo)
                    yield block()
                    made, lo, room = made + 1, hi, block_bytes
                room -= size
            held += [batch.slice(lo)] * (len(sizes) > lo)
        if held:
            yield block()

    def answer(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _batch(list(_answers(pa.Table.from_batches(group).to_pylist(), bits)))

    def gather(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's sums over a coarse range, as messages to its buckets, named by the group's range."""
        rows = [r for r in pa.Table.from_batches(group).to_pylist() if r["keys"] is not None]
        if not rows:
            return
        keys, counts, _ = _add([_read(r["keys"], r["counts"], bits) for r in rows])
        cuts = [_ranges(k, ranges * each) for k in keys]
        out = []
        for b in range(rows[0]["range"] * each, (rows[0]["range"] + 1) * each):
            part = [slice(c[b], c[b + 1]) for c in cuts]
            if any(p.stop > p.start for p in part):
                out.append((rows[0]["target"], b, b, *_message([k[p] for k, p in zip(keys, part, strict=True)], [c[p] for c, p in zip(counts, part, strict=True)], bits), None))
        yield _batch(out)

    def hand_down(left: pa.Table, right: pa.Table) -> pa.Table:
        """What the buckets told a group's range, to its blocks."""
        rows = left.to_pylist()
        asks = [r for r in rows if r["keys"] is not None]
        out = [tuple({**r, "target": r["asker"]}.values()) for r in rows if r["keys"] is None]
        if asks:
            _, _, places = _add([_read(r["keys"], r["counts"], bits) for r in asks])
            told = [_parts(x) for x in right.sort_by("range").column("counts").to_pylist()]
            every = [np.concatenate([_wide(x[o]) for x in told]) for o in _ORDERS]
            out += [(r["asker"], r["range"], r["asker"], None, _joined([_narrow(every[o][places[o][k]]) for o in _ORDERS]), None) for k, r in enumerate(asks)]
        return pa.Table.from_batches([_batch(out)])

    def traverse(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(pa.Table.from_batches(group).to_pylist(), key=lambda r: r["range"])
        texts, (train, missing, ids) = _unpack(rows[0]["texts"])
        block = Block.of(texts, bits)
        told = [_parts(r["counts"]) for r in rows[1:]]
        sums = [np.concatenate([_wide(x[o]) for x in told]).astype(np.int64) for o in _ORDERS]
        train = np.frombuffer(train, bool)
        if n:
            known, base = block.base(sums[0][block.places[0]], n, v)
            first = np.zeros(len(block.token), bool)
            first[block.first] = True
            full = np.add.reduceat(Automaton(block, sums, n, v, discount).traverse(first), block.first)
        else:
            known, base, full = np.zeros(len(train), np.int64), np.zeros(len(train)), np.zeros(len(train))
        ids = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(missing, bool))
        yield pa.RecordBatch.from_arrays(
            [ids, *map(pa.array, (~train, block.sizes, known, np.full(len(train), n, np.int64), base, full))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    asked = rows.mapInArrow(ask, _WIRE)
    if groups == 1:
        told = asked.groupBy("target").applyInArrow(answer, _WIRE)
    else:
        sums = asked.groupBy("target").applyInArrow(gather, _WIRE)
        heard = sums.groupBy("target").applyInArrow(answer, _WIRE)
        told = asked.groupBy("target").cogroup(heard.groupBy("asker")).applyInArrow(hand_down, _WIRE)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told.groupBy("asker").applyInArrow(traverse, schema)


def oracle(mod: int = 7, held: int = 2) -> str:
    """The same in DuckDB SQL, over the view documents; crc32 is worked out by its table."""
    crc = "list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))"
    weight = lambda c: f"({LAMBDA}::double * {c} / ({c} + {EVIDENCE}::double))"
    return f"""with k as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) as crc),
d as (select row_number() over () as id, doc_id, xor({crc}, 4294967295) % {mod} = {held} as held_out,
  list_transform(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> ''), lambda x: 'w' || x) as w from documents, k),
t as (select id, held_out, unnest(list_append(w, 'end')) as w, unnest(list_prepend('begin', w)) as h, unnest(list_concat([null, 'begin'], w[:-2])) as g from (select id, held_out, w from d where len(w) > 0) union all select id, held_out, 'end', 'begin', null from d where len(w) = 0),
c1 as (select w, count(*) as c from t where not held_out group by w), c2 as (select h, w, count(*) as c from t where not held_out group by h, w), c3 as (select g, h, w, count(*) as c from t where not held_out and g is not null group by g, h, w),
s as (select coalesce(sum(c), 0)::double as n, count(*)::double as v, (count(*) filter (where c = 1) + 1.0::double) / (count(*) filter (where c = 1) + 2 * count(*) filter (where c = 2) + 2) as disc from c1),
hist as (select w, c from c1 where w <> 'end' union all select 'begin', c from c1 where w = 'end'),
j as (select t.id, coalesce(c1.c, 0) as c, n, v, case when c1.c is null then disc * v / n else (c1.c - disc) / n end as p1, coalesce(hist.c, 0)::double as ch, coalesce(c2.c, 0)::double as chw, coalesce(gh.c, 0)::double as cgh, coalesce(c3.c, 0)::double as cghw
  from t cross join s left join c1 on t.w = c1.w left join hist on t.h = hist.w left join c2 on t.h = c2.h and t.w = c2.w left join c2 gh on t.g = gh.h and t.h = gh.w left join c3 on t.g = c3.g and t.h = c3.h and t.w = c3.w),
p as (select *, case when ch > 0 then {weight('ch')} * chw / ch + (1 - {weight('ch')}) * p1 else p1 end as p2 from j),
q as (select id, count(*) as n_tokens, count(*) filter (where c > 0) as n_known, any_value(n)::bigint as train_tokens, sum(case when n > 0 then log10((c + 1) / (n + v + 1)) else 0 end) as base_score,
  sum(case when n = 0 then 0 when cgh > 0 then log10({weight('cgh')} * cghw / cgh + (1 - {weight('cgh')}) * p2) else log10(p2) end) as score from p group by id)
select doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score from d join q using (id)"""
