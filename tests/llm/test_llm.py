"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import lm_scoring, ngram_join, ogg, packing, quality_rules, queries, source_mixing, token_counts, token_files, tokenizing, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _key string, label string"
BYTES, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}", len(t or ""), 0.5, "k", "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    long = " ".join(rng.choices(vocabulary, k=20_000))
    body = " ".join(rng.choices(vocabulary, k=120))
    rows = rows_of([None, "", "   ", "one", body, body, body + " tail", long, "a\nb\na\n\n", "it's  DON'T <|endoftext|> x", "日本語 ½ \xa0 é", "x" * 5000])
    rows += [rows[4], (None, body, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (50, None, "de", "", 0, 1.0, "q", "z")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_word_memory_is_the_library():
    rng = random.Random(1)
    some = ["".join(rng.choices(" \n\t'srtvelmdABc1 2!?.éÉ日²½_-ßİΣ́\xa0<|>", k=rng.randint(0, 60))) for _ in range(2000)] + ["a<|endoftext|>b", "", "  \n x"]
    for path in (BYTES, WORD):
        library = Tokenizer.from_file(path)
        expected = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(some, add_special_tokens=False)]
        assert tokenizing.memory(path).encode(some) == expected
        assert tokenizing.memory(path).encode(some) == expected


def test_word_memory_when_full(monkeypatch):
    monkeypatch.setattr(tokenizing, "KEPT", 10)
    memory = tokenizing.WordMemory(WORD)
    some = [f"word{i} other{i % 3}" for i in range(60)]
    expected = [np.asarray(e.ids, "<u4").tobytes() for e in memory.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    assert [memory.encode([t])[0] for t in some] == expected


def test_token_counts_are_the_library(docs, edge, empty):
    library = Tokenizer.from_file(BYTES)
    for df in (docs, edge):
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, BYTES).collect())
        expected = sorted((r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.select("doc_id", "text").collect())
        assert got == expected
    assert token_counts.token_counts(empty, BYTES).count() == 0


def test_token_counts_fuzz_and_dropped_states(monkeypatch):
    rng = random.Random(2)
    some = ["".join(rng.choices(" \n\t'srtvelmdABc1 2!?.é日 -ing", k=rng.randint(0, 80))) for _ in range(1500)] + ["-" * 300, " " * 200 + "x", "aaaa" * 90]
    library = Tokenizer.from_file(BYTES)
    expected = [len(e.ids) for e in library.encode_batch_fast(some, add_special_tokens=False)]
    counter = token_counts.counter(BYTES)
    assert counter.count(some) == expected
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    assert [counter.count([t])[0] for t in some[:100]] == expected[:100]


def test_token_counts_of_one_long_token_run():
    """Changes of more than 127 tokens on one transition, and more states in one call than are kept."""
    merges = token_counts.Merges([bytes([b]) for b in range(256)] + [b"ab" * k for k in range(1, 2)] + [b"a" * 300], {(b"a", b"b"): 0})
    raw = np.frombuffer(b"a" * 299 + b"b" + b"a" * 20, np.uint8)
    got = merges.counts(raw, np.array([0]), np.array([len(raw)]))
    assert got.tolist() == [len(merges._merge(raw.tobytes()))]


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31])
def test_packed_ids_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = rng.integers(0, 1 << bits, n).astype("<u4")
        assert (token_files.unpack(token_files.pack(ids, bits), bits, n) == ids).all()
    parts = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 3, 9000, 1)]
    held = token_files.Image(token_files.image([None, 1, 2, -5], parts, bits))
    assert held.doc_ids == [None, 1, 2, -5]
    assert all((held.document(k) == p).all() for k, p in enumerate(parts))


def test_token_files(spark, docs, edge, empty, monkeypatch):
    monkeypatch.setattr(token_files, "BROADCAST_IMAGES", 0)
    library = Tokenizer.from_file(WORD)
    for df in (docs, edge):
        got = token_files.round_trip(df, WORD, 2).orderBy("start").collect()
        given = df.select("doc_id", "text").collect()
        assert sorted(r.doc_id is not None and r.doc_id for r in got) == sorted(r.doc_id is not None and r.doc_id for r in given)
        assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
        expected = Counter((r.doc_id, zlib.crc32(np.asarray([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in given)
        assert Counter((r.doc_id, r.ids_crc32) for r in got) == expected
    assert token_files.round_trip(empty, WORD, 2).count() == 0


def test_packing(docs, edge, empty):
    library = Tokenizer.from_file(BYTES)
    for df in (docs, edge):
        got = packing.run(df, BYTES, 2).toPandas()
        assert (got.length <= 1024).all() and (got.length > 0).all()
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= 1024
        least = math.ceil(got.length.sum() / 1024)
        assert got.sequence_id.nunique() <= max(least + 2, 1.05 * least)
        assert got[got.piece > 0].length.eq(1024).all()
        expected = []  # the pieces of all documents
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
            expected += [(str(r.doc_id), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        name = got.doc_id.map(lambda x: "None" if pd.isna(x) else str(int(x)))
        assert sorted(expected) == sorted(zip(name, got.piece, got.start, got.length, got.ids_crc32, strict=True))
    limited = packing.run(docs, BYTES, 2, max_docs=3, max_cost=int(packing.cost_of(1024))).toPandas().groupby("sequence_id").length
    assert limited.count().max() == 3 and limited.agg(lambda x: packing.cost_of(x).sum()).max() <= packing.cost_of(1024)
    assert packing.run(empty, BYTES, 2).count() == 0


def _fewest(costs, limits):
    """The fewest bins by trying every assignment."""
    best = len(costs)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(costs):
            best = len(bins)
            return
        for b in range(len(bins)):
            after = tuple(x + y for x, y in zip(bins[b], costs[k], strict=True))
            if all(x <= y for x, y in zip(after, limits, strict=True)):
                place(k + 1, [*bins[:b], after, *bins[b + 1 :]])
        place(k + 1, [*bins, costs[k]])

    place(0, [])
    return best


def _plain_fit(lengths, limits, weights):
    """Vector best fit, one sequence after the other."""
    open_, out = [], []
    for size in lengths:
        cost = (size, 1, (-(-size // packing.TILE)) ** 2)
        fits = [b for b in open_ if all(x >= y for x, y in zip(b, cost, strict=True))]
        norm = lambda b: sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, b, cost, limits, strict=True))  # noqa: B023,E731
        if fits:
            best = min(map(norm, fits))
            out.append(best)
            b = next(b for b in fits if norm(b) == best)
        else:
            out.append(None)
            open_.append(b := list(limits))
        b[:] = [x - y for x, y in zip(b, cost, strict=True)]
    return out, len(open_)


def test_packing_by_brute_force():
    rng = random.Random(3)
    worse = 0
    for _ in range(60):
        lengths = np.array(sorted((rng.choice([rng.randint(1, 40), rng.randint(1, 400)]) for _ in range(9)), reverse=True))
        limits = (400, rng.choice([3, 9]), rng.choice([250, 650]))
        lengths = lengths[packing.cost_of(lengths) <= limits[2]]
        seq, _ = packing.best_fit(lengths, *limits)
        costs = [(int(x), 1, int(packing.cost_of(x))) for x in lengths]
        worse += len(set(seq.tolist())) - _fewest(costs, limits)
        assert len(set(seq.tolist())) == _plain_fit(lengths.tolist(), limits, packing.WEIGHTS)[1]
        for s in set(seq.tolist()):
            assert all(sum(c[k] for c, x in zip(costs, seq, strict=True) if x == s) <= limits[k] for k in range(3))
    assert worse <= 6  # of 60 runs


def test_packing_keeps_every_capacity():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 200, 500))[::-1]
    found = {}
    for docs_, cost in ((500, 10**6), (3, 10**6), (500, 180)):
        seq, offset = packing.best_fit(lengths, 400, docs_, cost)
        found[docs_, cost] = len(np.unique(seq))
        for s in np.unique(seq):
            x = lengths[seq == s]
            assert x.sum() <= 400 and len(x) <= docs_ and packing.cost_of(x).sum() <= cost
            assert sorted(offset[seq == s].tolist())[0] == 0
    assert found[500, 10**6] < min(found[3, 10**6], found[500, 180])  # both limits bind
    with pytest.raises(ValueError):
        packing.best_fit(np.array([500]), 400, 3, 10**9)


def test_packing_deals_rows_that_repeat(spark):
    df = spark.createDataFrame([(None, "same words again")] * 3000, "doc_id long, text string")
    got = packing.pack(packing.cut(packing.pieces(df, BYTES, 2)), shard_pieces=300).toPandas()
    assert len(got) == 3000 and (got.sequence_id // 2**32).value_counts().max() < 600


def test_ogg_checksum_and_damage():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
        return crc

    rng = random.Random(0)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow(data)
    for n in (64, 255 * 64, 4000, 4032, 200_000, 70_016):
        data = rng.randbytes(n)
        raw = ogg.write(data, n - 3)
        x, unpadded, seconds = ogg.samples(raw)
        assert x.tobytes() == data and unpadded == n - 3 and seconds == n / ogg.RATE
        at = rng.randrange(len(raw))
        with pytest.raises(ValueError):
            ogg.samples(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
        with pytest.raises(ValueError):
            ogg.samples(raw[: len(raw) - 1])


def test_ogg_packets_on_lacing_edges():
    packets = [(b"h" * 16, 0)] + [(bytes([k % 251]) * n, k) for k, n in enumerate([0, 1, 254, 255, 256, 510, 255 * 255, 255 * 255 + 1, 70_000])]
    got = ogg.read(b"".join(ogg.pages(5, packets)))[5]
    assert [p for p, _ in got] == [p for p, _ in packets]


def test_ogg_digests(edge, empty):
    got = ogg.media(edge, keep_media=True).toPandas()
    texts = Counter((r.doc_id, hashlib.sha256((b := (r.text or "").encode()) + b"\0" * (-len(b) % 64 or (0 if b else 64))).hexdigest()) for r in edge.select("doc_id", "text").collect())
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.payload_sha256) for r in got.itertuples()) == texts
    assert all(hashlib.sha256(m).hexdigest() == h for m, h in zip(got.media, got.media_sha256, strict=True))
    assert got.groupby("payload_sha256").feature.nunique().max() == 1
    for r, text in zip(got.sort_values("payload_sha256").itertuples(), sorted((x.text or "" for x in edge.select("text").collect()), key=lambda t: hashlib.sha256((b := t.encode()) + b"\0" * (-len(b) % 64 or (0 if b else 64))).hexdigest()), strict=True):
        raw = text.encode()
        data = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(data), zlib.crc32(data[-64:]), len(r.media))
    assert got.groupby("feature").payload_sha256.nunique().max() == 1  # and different texts differ in theirs here
    assert ogg.media(empty).count() == 0


def _lm_by_force(given):
    tokens = [[*WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None] for _, text in given]
    train = [zlib.crc32(("" if name is None else str(name)).encode()) % 7 != 2 for name, _ in given]
    count = Counter()
    for t, use in zip(tokens, train, strict=True):
        if use:
            count.update((w,) for w in ["<s>", *t])
            count.update(zip(["<s>", *t[:-1]], t, strict=True))
            count.update(zip(["<s>", *t[:-2]], t[:-1], t[1:], strict=False))
    uni = {k[0]: c for k, c in count.items() if len(k) == 1 and k != ("<s>",)}
    n, v = sum(uni.values()), len(uni)
    one, two = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    d = (one + 1) / (one + 2 * two + 2)

    def p(history, w):
        if not history:
            return (uni[w] - d) / n if w in uni else d * v / n
        c = count[history]
        weight = lm_scoring.LAMBDA * c / (c + lm_scoring.EVIDENCE)
        return (weight * count[*history, w] / c if c else 0) + (1 - weight) * p(history[1:], w)

    out = []
    for (name, _), t, use in zip(given, tokens, train, strict=True):
        base = sum(math.log10((uni.get(w, 0) + 1) / (n + v + 1)) for w in t)
        full = sum(math.log10(p(tuple(["<s>", *t][max(0, i - 1) : i + 1]), w)) for i, w in enumerate(t))
        out.append((name, not use, len(t), sum(w in uni for w in t), n, round(base, 5), round(full, 5)))
    return sorted(map(str, out))


def test_lm_scores_against_brute_force(spark, docs, edge, empty):
    for df in (docs, edge):
        expected = _lm_by_force([tuple(r) for r in df.select("doc_id", "text").collect()])
        for fan in (256, 2):  # blocks straight to the buckets, and in groups
            small = lm_scoring.score(df, block_bytes=40_000, bucket_bytes=60_000, fan=fan)
            got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in small.collect()]
            assert sorted(map(str, got)) == expected
    assert lm_scoring.score(empty).count() == 0


def test_lm_automaton_fails_twice_and_crosses_lanes():
    """A state of two words without an arc fails to one word, and from there to the root; a text is longer than a lane."""
    texts = ["a b c d e a b", "a b x", "zz b q", " ".join("abcdexyz"[i * i % 7] for i in range(3 * lm_scoring.LANE + 5)), "", "never a b zz"]
    given = [(i, t) for i, t in zip([k for k in range(50) if zlib.crc32(str(k).encode()) % 7 != 2][:5] + [next(k for k in range(50) if zlib.crc32(str(k).encode()) % 7 == 2)], texts, strict=True)]
    train = np.array([True] * 5 + [False])
    block = lm_scoring.Block.of([t.encode() for _, t in given], 64)
    counts = block.counts(train)
    words = counts[0]
    n, v, one, two = words.sum(), (words > 0).sum(), (words == 1).sum(), (words == 2).sum()
    made = lm_scoring.Automaton(block, counts, int(n), int(v), (one + 1) / (one + 2 * two + 2))
    assert set(made.order) == {0, 1, 2} and (made.order[made.fail[made.order == 2]] == 1).all() and (made.fail[made.order == 1] == 0).all()
    first = np.zeros(len(block.token), bool)
    first[block.first] = True
    got = np.add.reduceat(made.traverse(first), block.first)
    last = int(block.first[-1]) + 3  # "zz" after "a b": neither has an arc for it
    assert made.arcs[2, last] == made.arcs[1, last] == -1
    expected = {s.split(",")[0].strip("("): float(s.split(",")[-1].strip(" )")) for s in _lm_by_force(given)}
    assert all(abs(expected[str(name)] - x) < 1e-4 for (name, _), x in zip(given, got, strict=True))


def test_lm_rows_that_repeat_lie_in_many_blocks(spark):
    df = spark.createDataFrame([(None, "x y z x y")] * 400, "doc_id long, text string").repartition(4)
    got = lm_scoring.score(df, block_bytes=500, bucket_bytes=500).collect()
    assert len(got) == 400 and len({(r.score, r.n_tokens, r.n_known, r.train_tokens) for r in got}) == 1


def test_lm_with_nothing_to_learn_from(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm_scoring.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3


def _sets(texts):
    out = []
    for t in texts:
        w = WORDS.findall(t or "")
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def _classes(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) >= 0.8 * union) if union else True:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))], links


def test_ngram_join_against_brute_force(spark, docs, edge, empty, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    rng = random.Random(5)
    base = [str(rng.random()) for _ in range(150)]
    near = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = str(rng.random())
        near.append(" ".join(words))
    many = spark.createDataFrame(rows_of([*near, *near[:5], *[" ".join(str(rng.random()) for _ in range(60)) for _ in range(30)]]), SCHEMA)
    for df in (docs, edge, many):
        given = df.select("doc_id", "text").collect()
        comp, links = _classes(_sets([r.text for r in given]))
        least = {}
        for c, r in zip(comp, given, strict=True):
            if r.doc_id is not None:
                least[c] = min(least.get(c, r.doc_id), r.doc_id)
        expected = Counter((r.doc_id, least.get(c), n) for c, n, r in zip(comp, links, given, strict=True))
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(df).collect()) == expected
        kept = ngram_join.keep(df)
        assert kept.columns == df.columns and kept.count() == len(set(comp))
    assert ngram_join.join(empty).count() == 0 and ngram_join.keep(empty).count() == 0


def test_forest_recall_holds_for_any_number_of_long_leaves():
    depths = ngram_join.allowed_depths()
    assert depths == sorted(depths, reverse=True) and depths[0] == ngram_join.LONGEST > depths[-1] > ngram_join.SHORTEST
    for k, d in enumerate(depths):
        assert ngram_join.recall([ngram_join.SHORTEST] * (ngram_join.TREES - k) + [d] * k) >= ngram_join.RECALL


def _noisy(rng, base, most, n):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = str(rng.random())
        out.append(" ".join(words))
    return out


def test_forest_shortens_by_the_data(spark):
    """Large groups of near copies, of pages of one template and of other texts get leaves of different depths; no link is lost."""
    rng = random.Random(8)
    near = _noisy(rng, [str(rng.random()) for _ in range(150)], 6, 60)
    template = [str(rng.random()) for _ in range(60)]
    pages = [" ".join([*template, *(str(rng.random()) for _ in range(40))]) for _ in range(60)]
    texts = [*near, *pages, *(" ".join(str(rng.random()) for _ in range(60)) for _ in range(30))]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    classes = ngram_join.signatures(df).groupBy("_class").agg(F.any_value("_sig").alias("_sig"))
    got = ngram_join.leaves(classes, light=8).toPandas()
    assert {ngram_join.SHORTEST} < set(got.depth) and got.depth.nunique() >= 4
    by_class = got.groupby(got["_class"].map(bytes)).depth.apply(list)  # trees that are not listed have a leaf of one class
    assert min(ngram_join.recall([*d, *[ngram_join.SHORTEST] * (ngram_join.TREES - len(d))]) for d in by_class) >= ngram_join.RECALL
    inside = got.groupby("label").depth.nunique()
    assert (inside == 1).all()
    comp, links = _classes(_sets(texts))
    assert sorted((r.doc_id, r.n_links) for r in ngram_join.join(df, light=8).select("doc_id", "n_links").collect()) == list(enumerate(links))


def test_keep_takes_one_of_rows_that_tie(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, x, {"k": x}) for x in "abccba"] + [(2, text + " more", "z", None), (3, None, None, None), (None, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, m map<string,string>")
    runs = [sorted(map(str, ngram_join.keep(df.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 2


def test_quality_rules_edge_cases(edge, empty):
    got = quality_rules.judge(edge).toPandas()
    assert len(got) == edge.count()
    nothing = got[got.n_words == 0]
    assert len(nothing) == 5 and nothing.base_failed.all() and not nothing.kept.any()
    lines = got[got.doc_id == 8].iloc[0]
    assert (lines.n_words, lines.word_chars, lines.n_dup_lines, lines.n_repeat_words) == (3, 3, 1, 0)
    kept = quality_rules.keep(edge)
    assert kept.columns == edge.columns and kept.count() == int(got.kept.sum())
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(empty).count() == 0


def test_quality_rules_compare_windows_by_their_words(spark, monkeypatch):
    """Windows that share the bits kept of their hashes are no repeats: here no bits are kept."""
    text = " ".join(f"w{i}" for i in range(60)) + " w3 w4 w5"
    df = spark.createDataFrame(rows_of([text]), SCHEMA)
    expr = F.expr
    monkeypatch.setattr(quality_rules.F, "expr", lambda s: expr(s.replace("xxhash64(_w[i], _w[i + 1], _w[i + 2])", "0L")))
    assert quality_rules.judge(df).first().n_repeat_words == 6


def test_quality_rules_tell_junk(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.5


def test_repeat_words_by_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("ab cd e f".split(), k=rng.randint(0, 40))) for _ in range(60)]
    expected = []
    for t in texts:
        w = t.split()
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        expected.append(len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}))
    got = quality_rules.judge(spark.createDataFrame(rows_of(texts), SCHEMA)).orderBy("doc_id").toPandas()
    assert got.n_repeat_words.tolist() == expected


def test_mixing(edge, empty, docs):
    for df in (edge, docs):
        got = source_mixing.plan(df, bucket_rows=3).toPandas()
        by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
        assert (by.taken == np.floor(by.target)).all() and (by.target <= 3 * by["size"]).all()
        assert abs(by.target.sum() - got["size"].sum()) < 1e-6 * max(1, got["size"].sum())
        assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
        mixed = source_mixing.mix(df)
        assert mixed.columns == df.columns
        words = sum(len(WORDS.findall(r.text or "")) for r in mixed.select("text").collect())
        assert words == int(by.taken.sum())
    assert source_mixing.plan(empty).count() == 0 and source_mixing.mix(empty).count() == 0


def test_mixing_rows_that_repeat_and_odd_columns(spark):
    """Half of the rows are one row; columns with dots and maps; a key that ties in other columns."""
    rows = [(1, "one row of five words", "a", 0, {"k": 1})] * 60 + [(i, f"other {i} of five", "ab"[i % 2], i, None) for i in range(2, 40)] + [(2, "other 2 of five", "a", 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `n.c` long, m map<string,int>").repartition(3)
    got = source_mixing.plan(df, bucket_rows=5).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (by.taken == np.floor(by.target)).all()
    runs = [sorted(map(str, source_mixing.mix(df.repartition(n)).collect())) for n in (1, 4)]
    assert runs[0] == runs[1] and source_mixing.mix(df).columns == df.columns
    assert sum(len(WORDS.findall(r.text)) for r in source_mixing.mix(df).collect()) == int(by.taken.sum())


def test_mixing_targets_fill_up(spark):
    got = {r.source: r.target for r in source_mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), (None, 5)], "source string, source_size long")).collect()}
    assert got["c"] == 60.0 and got[None] == 15.0 and got["a"] == 30.0 and abs(got["b"] - 930.0) < 1e-9


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/71?x", "http://example.com/en/8", "http://x.net/de/1", "http://example.net/de/81", "http://org/es/", "http://evilcom/en/1", "http://a.com:80/en/", "ftp://b.org#f/es/1"]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, template string")).collect()}
    assert [got[i].rule for i in range(12)] == [None, None, None, None, "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None]
    assert got[4].host == "a.example.com" and got[4].path == "/en/71" and got[10].host == "a.com:80" and got[11].host == "b.org"
    assert got[8].verdict == "block" and got[9].verdict == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_templates_reject_by_purity(spark):
    bad = [(i, f"http://h{i % 2}.com/en/{i}/page{i}", "") for i in range(60)]
    near = [(100 + i, f"http://h0.com/EN/{i}", "") for i in range(3)]
    got = url_filter.judge(spark.createDataFrame([*bad, *near], "page_id long, url string, html string")).collect()
    assert {r.template for r in got if r.page_id < 60} == {"/*/*/*"}
    assert all(r.verdict == "block" for r in got if r.page_id < 60) and all(r.verdict == "allow" for r in got if r.page_id >= 100)


def test_url_siblings_that_differ_are_held_against_each_other(spark):
    rules = [(f"s{k}.com", f"/{d}/", v) for k in range(1) for d, v in (("a", "block"), ("b", "block"), ("c", "allow"), ("d", "allow"), ("e", "allow"))]
    urls = [f"http://s0.com/{d}/x{i}/{'ab'[i % 2]}q" for d in "abcdefg" for i in range(40)] + ["http://s0.com/" + "deep/" * 60 + "end"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    first = {d: {got[i].template.split("/")[1] for i, u in enumerate(urls) if u.split("/")[3] == d} for d in "abcdefg"}
    assert first["a"] == first["b"] == {"*+"} and first["c"] == first["d"] == first["e"] == {"*-"} and first["f"] == first["g"] == {"*"}
    assert got[len(urls) - 1].template == "/*" * 61 and {got[i].verdict for i in range(80)} == {"block"}


def test_url_repeated_rows_and_large_frames(spark, monkeypatch):
    """A url of many rows, null ones too, with the salted joins that large frames take."""
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(url_filter.join_small, "__defaults__", ("inner", 0, 4, None))
    urls = [None] * 30 + ["http://a.com/en/1"] * 30 + [f"http://a.com/fr/{i}/z" for i in range(9)]
    rows = [(i, u, "h", "t") for i, u in enumerate(urls)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, `a.b` string")).collect()
    assert sorted(r.page_id for r in got) == list(range(69)) and {(r.rule, r.verdict) for r in got if 30 <= r.page_id < 60} == {("com/en/", "block")}
    assert {(r.host, r.path, r.template, r.verdict) for r in got if r.page_id < 30} == {("", "", "/*", "allow")}


def test_toxicity(spark, edge, empty):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(20, 80))
        toxic.append(int(i % 5 == 0))
        if toxic[-1]:
            for _ in range(4):
                words[rng.randrange(len(words))] = "zorgh" + rng.choice(["ed", "en", "", "ing"])
        texts.append(" ".join(words))
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(df, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.predicted == held.toxic).mean()) > 0.95 and got.score.between(0, 1).all()
    kept = toxicity.keep(df, labels)
    assert kept.columns == df.columns and abs(kept.count() - 320) <= 10
    some = toxicity.judge(edge, labels).toPandas()
    assert len(some) == edge.count() and some.score.between(0, 1).all()
    assert toxicity.judge(empty, labels).count() == 0
    assert toxicity.judge(df, labels.where("toxic = 0")).agg(F.max("score")).first()[0] == 0.0


@pytest.mark.parametrize("n", [8, 40, 60])
def test_toxicity_with_few_labels(spark, n):
    """Small label sets are fitted and calibrated as large ones, with trees and curve on different rows."""
    rows = [(i, f"you zorgh zorghed idiot {i}!!" if i % 2 else f"a calm line about {i} things", i % 2) for i in range(6 * n)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[: 2 * n]], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert model.trees is not None
    got = toxicity.judge(df, labels).toPandas()
    assert ((got.score > 0.5) == (got.doc_id % 2 == 1)).mean() > 0.9


def test_toxicity_scores_by_brute_force(spark, docs):
    """The score of every document from its own features, the fitted trees walked by hand, and the curve's line through its corners."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels)
    make, x, y = toxicity.Features(model.lexicon), list(model.curve.boundaries), list(model.curve.predictions)
    trees = [(w, t) for w, t in zip(model.trees.treeWeights, model.trees.trees, strict=True)]

    def leaf(node, f):
        while node.numDescendants():
            split = node.split()
            node = node.leftChild() if f[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    expected = {}
    for r in docs.select("doc_id", "text").collect():
        f = make(r.text)
        margin = sum(w * leaf(t._call_java("rootNode"), f) for w, t in trees)
        expected[r.doc_id] = min(1.0, max(0.0, float(np.interp(margin, x, y))))
    got = {r.doc_id: r.score for r in toxicity.judge(docs, labels).collect()}
    assert set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-6 for k in got)


def test_toxicity_never_learns_from_held_out(spark):
    docs = spark.createDataFrame([(i, "x y z") for i in range(30)], "doc_id long, text string")
    held = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = spark.createDataFrame([(i, int(i in held)) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).trees is None


def test_features_see_disguise_and_shouting():
    f = toxicity.Features({"loser": 5.0})
    assert f("You LOSER!")[5] > 0 and f("you are a l0ser")[13] > 0 and f("calm words here")[0] == 0 and f(None) == [0.0] * toxicity.N_FEATURES
    assert f("loser you")[7] > f("loser a b c d e f g you")[7] > 0


def test_queries_are_registered():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
