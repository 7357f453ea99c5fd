"""Decontamination against brute force, in one automaton and in several."""

import hashlib
import random
import re

import pytest

from tracewell.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, item_id string, _raw string, spans long", "item_id string, text string, doc_id long"


def expected(text, items):
    """n_words, n_hit, items and spans by comparing every window with every place."""
    low = (text or "").translate(LOWER)
    at = [(m.start(), m.end()) for m in WORD.finditer(low)]
    found = [low[a:b] for a, b in at]
    hit, names = set(), set()
    for name, said in items:
        w = WORD.findall((said or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else []:
            window = w[k : k + 10]
            for p in range(len(found) - len(window) + 1):
                if found[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    names.add(name or "")
    spans = []
    for p in sorted(hit):
        if spans and p - 1 in hit:
            spans[-1] = (spans[-1][0], at[p][1])
        else:
            spans.append(at[p])
    return len(found), len(hit), sorted(names), spans


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    vocabulary = ["A1", "b", "Çé", "日本", "x9", "İ", "the", "OF", "z"]

    def text(n):
        return "".join(w + rng.choice([" ", ", ", "\n\n", " - ", "._"]) for w in rng.choices(vocabulary, k=n))

    items = [(str(k), text(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for k in range(12)] + [(None, text(14)), ("3", text(12)), ("77", None), ("78", " ?!"), ("79", "")]
    items += [items[0], ("80", items[5][1])]
    texts = [None, "", "...", "b", text(400)]
    for _ in range(60):
        a, b = rng.choice(items), rng.choice(items)
        texts.append(text(rng.randint(0, 30)) + " " + (a[1] or "") + rng.choice(["", "; ", "!"]) + (b[1] or "").upper() + text(rng.randint(0, 9)))
    texts.append(" ".join(t or "" for t in texts) * 3)
    docs = [(k, t, "i", "r", 1) for k, t in enumerate(texts)]
    docs += [docs[5], docs[5], (None, docs[6][1], None, None, None)]
    return docs, items, spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*x, 1) for x in items], ITEMS)


@pytest.mark.parametrize("pattern_bytes", [decontaminate.PATTERN_BYTES, 1500])
def test_is_brute_force(tables, pattern_bytes):
    docs, items, df, benchmark = tables
    got = [(r.doc_id or -1, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in decontaminate.find(df, benchmark, pattern_bytes=pattern_bytes).collect()]
    assert sorted(got, key=str) == sorted(((d[0] or -1, *expected(d[1], items)) for d in docs), key=str)
    assert any(x[3] for x in got) and any(not x[3] for x in got)


def test_digest(tables):
    docs, items, df, benchmark = tables
    got = {(r.doc_id or -1, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.judge(df, benchmark).collect()}
    found = [(d[0] or -1, expected(d[1], items)) for d in docs]
    assert got == {(k, len(x[2]), hashlib.sha256(",".join(x[2]).encode()).hexdigest(), x[1] > 0) for k, x in found}


def test_empty_tables(spark, tables):
    _, _, df, benchmark = tables
    assert decontaminate.find(spark.createDataFrame([], DOCS), benchmark).count() == 0
    none = decontaminate.find(df, spark.createDataFrame([], ITEMS)).collect()
    assert len(none) == df.count() and not any(r.n_hit or r["items"] or r.spans for r in none)
