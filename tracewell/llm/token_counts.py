"""Token counts by compiled finite-state transducers.

The first transducer splits text into pieces, as the vocabulary's pattern does. It reads
character classes and marks on its transitions where a piece begins, at the character read or
at the one before. Text is cut into chunks; each chunk's map from state to state is run for all
states at once, the maps are composed by a parallel prefix scan, and with its true first state
every chunk marks its own transitions.

The second reads the bytes of a piece and emits, on each transition, by how much the number of
tokens changes. A state holds, for every suffix of what was read that still can become a token,
the token before that suffix and the tokens counted since; a token follows another one if
merging the bytes of both gives just these two. Its transitions are compiled when first met and
kept by the worker process, up to a bound at which they are dropped and compiled anew. All
pieces of a batch step through it side by side.

Defined cases: a null text is an empty one, with no tokens. A special token's string in a text
is one token, as by the library's default. A code point that this Python's Unicode tables do
not know counts as neither letter nor number. A very long text is one group of its task, and states
beyond twice the bound are dropped within it. Repeated rows are counted each; there are no ties to
break. An empty table gives no rows; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ship, spread

CHUNK = 128
GROUP_CHARS = 1_000_000
MOST_STATES = 500_000
LIMIT = 512

#: Character classes: letters that can end a contraction apart, then the rest.
LETTER, SHORT, R, V, L_, E, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(12)
#: Fixed value: white space beyond the single space.
WHITE_POINTS = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
(START, IN_LETTERS, IN_NUMBER, IN_OTHER, CLOSED, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, SPACE_1, SPACE_N, WHITE_1, WHITE_N) = range(13)
HERE, BEFORE = 1, 2
#: Added to changes of the count, which are less than the longest token's bytes.
CHANGE = 1 << 31


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_POINTS] = WHITE
    for chars, kind in (("stmd", SHORT), ("r", R), ("v", V), ("l", L_), ("e", E), (" ", SPACE), ("'", QUOTE)):
        table[[ord(c) for c in chars]] = kind
    return table


def _begin(x: int) -> int:
    return {NUMBER: IN_NUMBER, SPACE: SPACE_1, WHITE: WHITE_1, QUOTE: QUOTED, OTHER: IN_OTHER, END: START}.get(x, IN_LETTERS)


def _piece_step(state: int, x: int) -> tuple[int, int]:
    """Next state and marks of the piece transducer."""
    letter = x <= E
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):  # a quote and one letter: a contraction with the right letter, else two pieces
        if x == (L_ if state == QUOTED_L else E):
            return CLOSED, 0
        after, marks = _piece_step(IN_LETTERS, x)
        return after, marks | BEFORE
    if x == END:
        return START, 0
    if state == QUOTED and x in (SHORT, R, V, L_):
        return {SHORT: CLOSED, R: QUOTED_R, V: QUOTED_V, L_: QUOTED_L}[x], 0
    if state in (IN_OTHER, QUOTED) and x in (OTHER, QUOTE) or state == IN_LETTERS and letter or state == IN_NUMBER and x == NUMBER:
        return {QUOTED: IN_OTHER}.get(state, state), 0
    if state in (SPACE_1, SPACE_N, WHITE_1, WHITE_N):
        if x in (SPACE, WHITE):
            return (SPACE_N if x == SPACE else WHITE_N), 0
        joined = IN_OTHER if x == QUOTE else _begin(x)  # a single space joins what follows
        return {SPACE_1: (joined, 0), SPACE_N: (joined, BEFORE), WHITE_1: (_begin(x), HERE), WHITE_N: (_begin(x), HERE | BEFORE)}[state]
    return _begin(x), HERE


class Pieces:
    """The piece transducer over arrays of code points."""

    def __init__(self) -> None:
        self.classes = _classes()
        steps = [_piece_step(s, x) for s in range(13) for x in range(12)]
        self.next = np.array([s for s, _ in steps], np.uint8)
        self.marks = np.array([m for _, m in steps], np.uint8)

    def _maps(self, cls: np.ndarray) -> np.ndarray:
        """The state each chunk (a column) ends in, for every first state; columns where all have met go on as one."""
        out = np.repeat(np.arange(13, dtype=np.uint8)[:, None], cls.shape[1], axis=1)
        open_ = np.arange(cls.shape[1])
        for k in range(len(cls)):
            out[:, open_] = self.next[out[:, open_] * np.uint8(12) + cls[k, open_]]
            if k % 4 == 3:
                met = (out[:, open_] == out[0, open_]).all(0)
                if met.any():
                    done, open_ = open_[met], open_[~met]
                    state = out[0, done]
                    sub = cls[:, done]
                    for j in range(k + 1, len(cls)):
                        state = self.next[state * np.uint8(12) + sub[j]]
                    out[:, done] = state
                if not len(open_):
                    break
        return out

    def starts(self, cls: np.ndarray) -> np.ndarray:
        """Whether a piece begins, for each position of the class sequence."""
        n, width = len(cls), -(-len(cls) // CHUNK)
        grid = np.full(width * CHUNK, END, np.uint8)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(width, CHUNK).T)
        maps = self._maps(grid)
        step = 1
        while step < width:  # after each round a column holds the composition of twice as many chunks
            later = maps.copy()
            later[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), 0)
            maps, step = later, 2 * step
        state = np.concatenate([[START], maps[START, :-1]]).astype(np.uint8)
        marks = np.empty_like(grid)
        for k in range(CHUNK):
            at = state * np.uint8(12) + grid[k]
            marks[k], state = self.marks[at], self.next[at]
        flat = marks.T.reshape(-1)
        begins = (flat & HERE).astype(bool)
        begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
        return begins[:n]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The transducer from the bytes of a piece to its number of tokens."""

    def __init__(self, tokens: list[bytes], ranks: dict[tuple[bytes, bytes], int]):
        self.tokens, self.ranks = tokens, ranks
        self.names = {t: i for i, t in enumerate(tokens)}
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for i, t in enumerate(tokens):
            node = 0
            for b in t:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            if self._merge(t) == [t]:
                self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        first = array("i", (0, -1, 0)).tobytes()
        self.states: list[bytes] = [first]
        self.ids = {first: 0}
        self.filled = 0
        self._room(1 << 18)

    def _forget(self, held: np.ndarray) -> np.ndarray:
        """Drop all states but those held, and give these their new numbers."""
        kept, place = np.unique(held, return_inverse=True)
        kept = [self.states[k] for k in kept.tolist()]
        self._clear()
        for x in kept:
            if x not in self.ids:
                self.ids[x] = len(self.states)
                self.states.append(x)
        return np.array([self.ids[x] for x in kept], np.int64)[place]

    def _room(self, slots: int) -> None:
        """An empty table of transitions: open addressing, keys state << 8 | byte, values state << 32 | change + CHANGE."""
        self.keys, self.values, self.shift = np.full(slots, -1, np.int64), np.zeros(slots, np.int64), np.uint64(65 - slots.bit_length())

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot where it would be."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        there = self.keys[slot]
        off = np.flatnonzero((there != keys) & (there != -1))
        while off.size:
            slot[off] = (slot[off] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[off]]
            off = off[(there != keys[off]) & (there != -1)]
        return slot

    def _store(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.filled += len(keys)
        if 3 * self.filled > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self._room(4 * len(self.keys))
        while len(keys):  # of keys that want one slot the last written holds it; the others look again
            slot = self._slots(keys)
            self.keys[slot] = keys
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values = keys[~won], values[~won]

    def _merge(self, raw: bytes) -> list[bytes]:
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > MOST_STATES:
                self.pairs.clear()
            x, y = self.tokens[a], self.tokens[b]
            known = self.pairs[a, b] = self._merge(x + y) == [x, y]
        return known

    def _compile(self, state: int, byte: int) -> int:
        held = array("i", self.states[state]).tolist()
        steps = [(c, last, since) for node, last, since in zip(held[::3], held[1::3], held[2::3], strict=True) if (c := self.child[node].get(byte)) is not None]
        for c, last, since in steps:
            t = self.token[c]
            if t >= 0 and (last < 0 or self._follows(last, t)):
                delta = 1 - since
                break
        else:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        after = array("i", [x for c, last, since in steps if self.child[c] for x in (c, last, since + delta)] + [0, t, 0]).tobytes()
        if (to := self.ids.get(after)) is None:
            to = self.ids[after] = len(self.states)
            self.states.append(after)
        return to << 32 | delta + CHANGE

    def counts(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The tokens of each piece data[begin : begin + length]."""
        if len(self.states) > MOST_STATES:
            self._clear()
        order = np.argsort(-lengths, kind="stable")
        at, size = begins[order], lengths[order]
        longer = len(size) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1), side="left")
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for step, live in enumerate(longer.tolist()):
            key = (state[:live] << 8) + data[at[:live] + step]
            slot = self._slots(key)
            if (new := np.flatnonzero(self.keys[slot] != key)).size:
                fresh = np.unique(key[new])
                self._store(fresh, np.array([self._compile(k >> 8, k & 255) for k in fresh.tolist()], np.int64))
                slot = self._slots(key)
            got = self.values[slot]
            state[:live] = got >> 32
            total[:live] += (got & 0xFFFFFFFF) - CHANGE
            if len(self.states) > 2 * MOST_STATES:
                state[:live] = self._forget(state[:live])
        out = np.empty_like(total)
        out[order] = total
        return out


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        self.merges = Merges([raw(t) for t in spec["model"]["vocab"] if t not in self.special], ranks)
        self.pieces = Pieces()

    def count(self, texts: list[str]) -> list[int]:
        out, segments, owner = np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            parts = [t]
            for s in self.special:
                parts = [x for p in parts for x in p.split(s)]
            out[i] = len(parts) - 1
            segments += parts
            owner += [i] * len(parts)
        lo = 0
        while lo < len(segments):
            hi, chars = lo, 0
            while hi < len(segments) and (hi == lo or chars + len(segments[hi]) <= GROUP_CHARS):
                chars, hi = chars + len(segments[hi]), hi + 1
            np.add.at(out, owner[lo:hi], self._segments(segments[lo:hi]))
            lo = hi
        return out.tolist()

    def _segments(self, segments: list[str]) -> np.ndarray:
        joined = "".join(segments)
        if not joined:
            return np.zeros(len(segments), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(s) for s in segments])
        cls = np.insert(self.pieces.classes[points], ends, END)
        begins = np.delete(self.pieces.starts(cls), ends + np.arange(len(ends)))
        first = np.flatnonzero(begins)
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        data = np.frombuffer(joined.encode(), np.uint8)
        counts = self.merges.counts(data, at[first], np.diff(np.append(at[first], at[-1])))
        return np.bincount(np.searchsorted(ends, first, side="right"), weights=counts, minlength=len(segments)).astype(np.int64)


_made: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker process's Counter for a vocabulary file."""
    if path not in _made:
        _made[path] = Counter(path)
    return _made[path]


def token_counts(docs: DataFrame, vocab: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs."""

    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counter(vocab)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                counts = held.count(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return spread(rows).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
