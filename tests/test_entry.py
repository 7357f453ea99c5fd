"""The driver's entry without the training-data operators."""

import sys

import __spark_entry__ as entry
from tracewell import queries as own


def test_entry_without_what_llm_needs(monkeypatch):
    for name in [k for k in sys.modules if k == "corpus_pipeline" or k.startswith("tracewell.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)  # its import now fails
    assert set(entry.queries()) == set(own.QUERIES) and set(entry.oracle_sql()) == set(own.ORACLES)
