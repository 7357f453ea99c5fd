"""The conversation trie against a trie of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tracewell.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, ordinal long, c string, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        token = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        turns[conv].append((turn is not None, turn or 0, role, len(text), token, text))
    own = {c: [(t[2], t[5]) for t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c, ts in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = [] if c is None else own.get(c - c % 100, [])
        made[c] = tuple(base[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    order = lambda c: (c is None, c or 0)
    children, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    for path, who in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1]) if path else 0
            leaves[path[:d]] += path not in children
    out = []
    for path, who in members.items():
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c in who if made[c] == path), key=order))
        up = min(members[path[:-1]], key=order) if path else None
        out.append((min(who, key=order), len(path), up, len(who), len(children[path]) if path in children else 0, leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=str)


def some(seed, convs):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample([*range(0, 330), -7, -100, 2**62], convs):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "bot", None, ""]), rng.choice(["a", "bé", "日本語", "", None])))
    for c in rng.sample(range(400, 900), 12):  # long ones that agree for long, and copies
        rows += [(c, t, "user", "xy" if t < rng.choice([9, 30]) else f"{c % 3}") for t in range(rng.choice([20, 40]))]
    for c in range(1000, 1030):
        rows += [(c, t, "user", "same") for t in range(7)]
    rows += [(None, 0, "user", "a"), (None, 1, None, None), rows[0], rows[0], (100, None, None, None)]
    rng.shuffle(rows)
    return [(*r, 1, "k", None) for r in rows]


@pytest.mark.parametrize("sizes", [(4096, 32, 64, 8), (8, 4, 3, 4)])
def test_is_a_trie(spark, sizes):
    rows = some(sizes[0], 90)
    block, fan, first, grow = sizes
    assert got(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), block, fan, first, grow)) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None), (5, 0, "user", "hi")], [(c, t, "u", "x") for c in range(0, 60) for t in range(2)]])
def test_small_tables(spark, rows):
    rows = [(*r, 0, "", "") for r in rows]
    assert got(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA), 24, 2)) == (expected(rows) if rows else [])


def test_levels_agree_on_random_arrays():
    """Blocks of any size give the nodes that one block gives."""
    rng = random.Random(5)
    node = conversation_trie.Node
    for _ in range(200):
        strings = sorted("".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 40)))
        lcp = [-1] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(strings, strings[1:], strict=False)]

        def entries():
            return [(node(d, k), node(len(s), None, 1, k, 0, 1, 0, list(range(len(s) + 1)))) for k, (d, s) in enumerate(zip(lcp, strings, strict=True))]

        def nodes(rows):
            return sorted((r["lo"], r["hi"], r["conv"], r["n"], r["children"], r["leaves"], r["below"]) for r in rows if r["kind"] in ("node", "leaf"))

        level, size, rows = [entries()[k : k + 3] for k in range(0, len(strings), 3)], 2, []
        while True:
            last, left = len(level) == 1, []
            for block in level:
                found = conversation_trie.contract(block, last)
                rows += found
                part = []
                for r in found:
                    x = node(r.get("hi"), r.get("id"), r.get("n"), r.get("conv"), r.get("children"), r.get("leaves"), r.get("below"), r.get("cum"))
                    if r["kind"] == "open":
                        part.append((x, None))
                    elif r["kind"] == "item":
                        part[-1] = (part[-1][0], x)
                left.append(part)
            if last:
                break
            level = [[e for part in left[k : k + size] for e in part] for k in range(0, len(left), size)]
        assert nodes(rows) == nodes(conversation_trie.contract(entries(), True))
