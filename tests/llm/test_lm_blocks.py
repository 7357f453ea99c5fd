"""What a block of texts sends, and how its words are numbered."""

import zlib

from tracewell.llm import lm_scoring as L


def test_compressed_texts_are_not_compressed_again(monkeypatch):
    levels = []
    monkeypatch.setattr(L.zlib, "compress", lambda raw, level, whole=zlib.compress: levels.append(level) or whole(raw, level))
    texts = [b"a text", b"", b"another"]
    assert L._unpack(L._pack(texts, b"more")) == (texts, [b"more"])
    assert levels == [0]


def test_words_are_numbered_as_they_come():
    b = L.Block.of([b"a B a", b"", b"b c"], 64)
    assert b.token.tolist() == [0, 1, 0, 3, 3, 1, 2, 3] and b.sizes.tolist() == [4, 1, 3] and len(b.hashes) == 5
