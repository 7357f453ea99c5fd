"""Words of letters and digits: ASCII punctuation, spaces and control codes part them, only A to Z is lower-cased."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what parts the words of a lower-cased text.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Every byte of a text as itself, in lower case, or as a space; those of letters beyond ASCII stay.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def fold(raw: bytes) -> bytes:
    """A UTF-8 text of the same length in which every word stands where it stood and the rest is spaces."""
    return raw.translate(_FOLD)


def offsets(folded: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words `first` begin and words `last` end in the original text, in code points."""
    raw = np.frombuffer(folded, np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    begins, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[begins[first]], points[ends[last]]


def words(text: Column) -> Column:
    """The words of a text in order, as the functions above find them; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), PARTS), "")


def sql_words(text: str) -> str:
    """The same in DuckDB."""
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{PARTS}'), lambda x: x <> '')"
