"""The pipeline's mixing stage keeps texts whole."""

from collections import Counter

import corpus_pipeline
from tracewell.llm import source_mixing


def test_mixing_stage_cuts_no_text(spark):
    rows = [(i, f"one\ntwo  three\n\n{i} " * (1 + i % 7), "en", f"s{i % 3}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = source_mixing.plan(docs).collect()
    assert any(0 < r.taken % r["size"] for r in plan)  # a budget ends inside a text
    got = corpus_pipeline.mixed(spark, docs, "").collect()
    assert {tuple(r) for r in got} <= set(rows)
    assert Counter(r.doc_id for r in got) == Counter({r.doc_id: -(-r.taken // r["size"]) for r in plan if r.taken})
    for source in ("s0", "s1", "s2"):
        words = sum(len(r.text.split()) for r in got if r.source == source)
        budget = sum(r.taken for r in plan if r.source == source)
        assert 0 <= words - budget < max(r["size"] for r in plan)
