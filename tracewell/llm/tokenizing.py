"""Ids of whole texts by the tokenizers library, with the library's results kept by piece.

The library works on every run of letters, and on what stands between such runs, by itself, so
what it gave for a piece holds for every other place of that piece. Pieces met for the first time
go to the library together: runs of letters as one text, which its own marks of word ends (or
beginnings) cut up again, others one by one. Texts with special strings, or with characters
beyond ASCII, Latin letters and plain punctuation, go to the library whole. The memory per
worker process is bounded.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces kept by a worker process; one is about two hundred bytes.
KEPT = 300_000
#: What a text may hold to be cut into pieces here, besides ASCII: fixed values. No character of these combines with another one.
_BEYOND = re.compile("[^\x00-\x1b!-\x7e ¡-§©-±´-·º»¿-ɏ‐-‧€]")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_BETWEEN = rf"(?:[^ \t-\r'{_LETTER}]+|'[{_LETTER}]*)+"
_DROPPED = re.compile(rf"[{_LETTER}]+|{_BETWEEN}")
_HELD = re.compile(rf" ?[{_LETTER}]+| ?{_BETWEEN}|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")

_made: dict[str, WordMemory] = {}


def memory(path: str) -> WordMemory:
    """This worker process's WordMemory for a vocabulary file."""
    if path not in _made:
        _made[path] = WordMemory(path)
    return _made[path]


class WordMemory:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False)
        #: Spaces belong to pieces where the vocabulary can say a space; case is dropped where it makes no difference.
        self.spaced = one("a b").tokens[-1].startswith("Ġ")
        self.caseless = one("QUITE Ä").ids == one("quite ä").ids
        self.pieces = (_HELD if self.spaced else _DROPPED).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.edge = np.zeros(names[-1][1] + 1, bool)
        self.edge[[i for t, i in names if (t.startswith("Ġ") if self.spaced else t.endswith("</w>"))]] = True
        self.known: dict[str, bytes] = {}
        self.passed = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """The library's ids of pieces."""
        plain = [w for w in pieces if (w[:1] == " " and w[1:].isalpha() if self.spaced else w.isalpha())]
        found: dict[str, bytes] = {}
        if plain:
            ids = np.asarray(self.tokenizer.encode_batch_fast([("" if self.spaced else " ").join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.edge[ids])
            cuts = [*at.tolist(), len(ids)] if self.spaced else [0, *(at + 1).tolist()]
            if len(cuts) == len(plain) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
                raw = ids.tobytes()
                found = {w: raw[4 * a : 4 * b] for w, a, b in zip(plain, cuts, cuts[1:], strict=False)}
        rest = [w for w in pieces if w not in found]
        found.update(zip(rest, self._library(rest), strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if not t.isascii() and _BEYOND.search(t) or any(s in t for s in self.special)]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        apart, group, chars = set(whole), [], 0
        for i, t in enumerate(texts):
            if i not in apart:
                group.append(i)
                chars += len(t)
                if chars > 1_000_000:
                    self._group(texts, group, out)
                    group, chars = [], 0
        if group:
            self._group(texts, group, out)
        return out

    def _group(self, texts: list[str], group: list[int], out: list[bytes]) -> None:
        split = [self.pieces(texts[i].lower() if self.caseless else texts[i]) for i in group]
        known, new = self.known, set()
        raw = [list(map(known.get, pieces)) for pieces in split]
        lacking = [[k for k, ids in enumerate(some) if ids is None] if None in some else [] for some in raw]
        for pieces, at in zip(split, lacking, strict=True):
            new.update([pieces[k] for k in at])
        found = self._new(list(new))
        for i, pieces, some, at in zip(group, split, raw, lacking, strict=True):
            for k in at:
                some[k] = found[pieces[k]]
            out[i] = b"".join(some)
        if len(known) + len(found) <= KEPT:
            known.update(found)
        else:  # full: pieces met first stay, until most of what came was new
            self.passed += len(found)
        if self.passed > 4 * KEPT:
            known.clear()
            self.passed = 0
