"""Lexical search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, query string, block long, score double", "item_id string, text string, term string, rank int"


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def expected(docs, items, k=20):
    sizes = [len(terms(d[1])) for d in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    tfs = [Counter(terms(d[1])) for d in docs]
    df = Counter(t for tf in tfs for t in tf)
    out = []
    for item, text, *_ in items:
        found = []
        for d, size, tf in zip(docs, sizes, tfs, strict=True):
            m = 75 + 25 * size * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if score > 0:
                found.append((-score, d[0] is None, d[0] or 0))
        out += [(item or "", rank, None if null else d, -score) for rank, (score, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id or "", r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(12)
    vocabulary = [w for k in range(60) for w in [f"W{k}"] * (1 + 60 // (k + 1))] + ["Éa", "日本", "İx"]
    texts = [None, "", " ?! "] + [rng.choice([" ", ", "]).join(rng.choices(vocabulary, k=rng.choice([1, 3, 8, 40]))) for _ in range(400)] + [" ".join(rng.choices(vocabulary, k=9000))]
    docs = [(k, t, "q", 1, 0.5) for k, t in enumerate(texts)]
    docs += [docs[20]] * 30 + [(None, docs[21][1], None, None, None), (900, docs[21][1], None, None, None)]
    rng.shuffle(docs)
    items = [(str(k), " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 30]))), "t", 1) for k in range(15)]
    items += [("15", None, "t", 1), ("16", "...", "t", 1), ("17", "nowhere", "t", 1), (None, docs[5][1] or "w1", "t", 1)]
    return docs, items, spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)


@pytest.mark.parametrize("blocks", [(64, 4, 512), (3, 1, 7)])
def test_is_brute_force(tables, monkeypatch, blocks):
    for name, value in zip(("BLOCK_DOCS", "SEED_BLOCKS", "SORTED_BLOCKS"), blocks, strict=True):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items, df, queries = tables
    assert got(lexical_search.search(df, queries)) == expected(docs, items)


def test_batches_and_repeated_queries(tables, spark):
    docs, items, df, _ = tables
    assert got(lexical_search.search(df, spark.createDataFrame([*items, items[3]], ITEMS), k=5, batch_queries=12)) == expected(docs, [*items, items[3]], 5)


def test_empty_tables(tables, spark):
    _, _, df, queries = tables
    assert got(lexical_search.search(spark.createDataFrame([], DOCS), queries)) == []
    assert got(lexical_search.search(df, spark.createDataFrame([], ITEMS))) == []


def test_bounds_hold_and_prune():
    """A bound is never below a score in its block, and blocks of low bounds are left alone."""
    rng = np.random.default_rng(3)
    n_terms, n_queries = 50, 9
    query = np.repeat(np.arange(n_queries), 6)
    term = np.concatenate([rng.choice(n_terms, 6, replace=False) for _ in range(n_queries)])
    asked = lexical_search.Queries(query, term, rng.integers(0, 9000, len(term)), n_queries, n_terms)
    table = np.zeros(n_terms, np.int64)
    for _ in range(40):
        each = [np.sort(rng.choice(n_terms, rng.integers(0, 12), replace=False)) for _ in range(10)]
        starts, terms_, found = np.cumsum([0, *map(len, each)]), np.concatenate(each), rng.integers(1, 10**6, sum(map(len, each)))
        held = np.unique(terms_)
        most = np.zeros(len(held), np.int64)
        np.maximum.at(most, np.searchsorted(held, terms_), found)
        bounds = asked.bounds(held, most)
        for q in range(n_queries):
            scores = asked.scores(q, table, starts, terms_, found)
            mine = dict(zip(asked.terms[asked.starts[q] : asked.starts[q + 1]].tolist(), asked.weights[asked.starts[q] : asked.starts[q + 1]].tolist(), strict=True))
            assert scores.tolist() == [sum(mine.get(t, 0) * x for t, x in zip(terms_[a:b].tolist(), found[a:b].tolist(), strict=True)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            assert bounds[q] >= scores.max() and not table.any()
