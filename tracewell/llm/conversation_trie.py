"""A prefix trie of conversations, from the Cartesian tree over their LCP array.

Turns become 16-byte tokens (MD5 of role and text); a conversation is the string of its tokens. The
conversations are sorted, and lcp[i] is how many turns number i shares with the one before it. Nodes
with several members are the intervals of that array between the nearest smaller values to both
sides. These are found in parallel: a block of BLOCK neighbours resolves, with a stack, every value
whose nearest smaller values lie in the block, and joins neighbours of equal values to one node.
What is left of a block are its minima from either side, a strictly falling and a strictly rising
chain with what they have gathered so far; the chains of FAN blocks are one block of the next level,
until one is left. A node gathers number, least id, leaves and saved tokens of what it takes in, so
intervals are never read again. Depths without a branch, missing in the Cartesian tree, are expanded
at the end: those of shared nodes from sums of code points along the path, those of a conversation
alone from its length, in pieces of PIECE depths.

What moves: no text after the tokens. Places of turns come from a sort by ranges, so one
conversation may hold any share of the turns. A sort key holds the first FIRST tokens; only for
conversations that agree in all of them are more fetched, GROW times as many a round, so keys are
as long as what is shared. A chain is at most as long as the greatest shared depth.

Defined cases: a null role or text is empty. Turns of one number are ordered by role, number of code
points, token. Repeated rows are turns of their own. Rows without conv_id are one conversation,
which comes after all others and is written as an empty string; its checksum is that of the empty
string, and it has no base. An empty table has no nodes, not even the root. Turns of a conversation
that its base replaces are gone; a turnless one belongs to the root alone. Very long texts go whole
into their token. Other columns may have any names; they are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, join_small, remove, shared_dir, ship
from tracewell.operators.ordinal import ordinal

EVERY, MOST_SHARED = 100, 6
BLOCK, FAN = 4096, 32
FIRST, GROW = 64, 8
PIECE = 1024
TOKEN = 16
NOBODY = hashlib.sha256(b"").hexdigest()
_ROW = "kind string, block long, seq long, id long, parent long, lo long, hi long, conv long, n long, children long, leaves long, below long, cum array<long>"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_KINDS = pa.schema([(c, pa.string() if c == "kind" else pa.list_(pa.int64()) if c == "cum" else pa.int64()) for c in _NAMES])


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


@dataclass
class Node:
    """A node, open or done, or a conversation; cum[d] is the code points of its first d turns, `below` what is saved in its subtree but for its own path."""

    depth: int
    id: int | None
    n: int = 0
    conv: int | None = None
    children: int = 0
    leaves: int = 0
    below: int = 0
    cum: list[int] | None = None

    def row(self, kind: str, seq: int) -> dict:
        return {"kind": kind, "seq": seq, "id": self.id, "hi": self.depth, "conv": self.conv, "n": self.n, "children": self.children, "leaves": self.leaves, "below": self.below, "cum": self.cum}


def _take(node: Node, item: Node, out: list[dict]) -> None:
    """An item becomes a child of an open node, or a conversation that ends there."""
    node.conv = item.conv if node.n == 0 else _least(node.conv, item.conv)
    node.n += item.n
    if node.cum is None:
        node.cum = item.cum[: max(node.depth, 0) + 1]
    if item.depth == node.depth:
        out.append({"kind": "end", "parent": node.id, "conv": item.conv})
        return
    alone, low = item.id is None, max(node.depth, 0)
    node.children += 1
    node.leaves += item.leaves
    node.below += item.below if alone else item.below + (item.n - 1) * (item.cum[item.depth] - item.cum[low])
    out.append(item.row("leaf" if alone else "node", 0) | {"parent": node.id, "lo": node.depth + 1, "cum": None if alone else item.cum[low : item.depth + 1]})


def _join(node: Node, other: Node, out: list[dict]) -> None:
    """Two parts of one node, which two blocks have gathered."""
    if other.n:
        node.conv = other.conv if node.n == 0 else _least(node.conv, other.conv)
        node.cum = node.cum or other.cum
    node.n, node.children, node.leaves, node.below = node.n + other.n, node.children + other.children, node.leaves + other.leaves, node.below + other.below
    out.append({"kind": "same", "id": other.id, "parent": node.id})


def contract(entries: list[tuple[Node, Node | None]], last: bool) -> list[dict]:
    """Rows of what is resolved in a block of (open node of the value to the left, item or none), and of what is left of it.

    With `last` there are no neighbours: the first value is -1, and another -1 follows.
    """
    out: list[dict] = []
    falling: list[Node] = []
    rising: list[Node] = []
    item: Node | None = None

    def until(depth: int) -> None:
        """Close the open nodes deeper than the value that comes next."""
        nonlocal item
        while rising and rising[-1].depth > depth:
            node = rising.pop()
            if item is not None:
                _take(node, item, out)
            item = None
            if rising:
                node.leaves = node.leaves or 1
                item = node
            else:  # its nearest smaller value to the left lies in another block
                falling.append(node)

    for node, then in entries:
        until(node.depth)
        if rising and rising[-1].depth == node.depth:
            if node.n or node.children:
                _join(rising[-1], node, out)
        else:
            rising.append(node)
        if item is not None:
            _take(rising[-1], item, out)
        item = then
    if last:
        until(-1)
        _take(rising[-1], item, out)
        return out
    seq = 0
    for seq, node in enumerate(falling + rising):
        out.append(node.row("open", seq))
    if item is not None:
        out.append(item.row("item", seq + 1))
    return out


def _table(rows: list[dict], block: int) -> pa.Table:
    for r in rows:
        r["block"] = block
    return pa.table({c: pa.array([r.get(c) for r in rows], _KINDS.field(c).type) for c in _NAMES}, schema=_KINDS)


def shared(a: bytes, b: bytes) -> int:
    """How many tokens two keys begin with alike."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k : k + TOKEN] == b[k : k + TOKEN]:
        k += TOKEN
    return k // TOKEN


def _first_level(last: bool):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ordinal"])
        block = key[0].as_py()
        entries, before = [], None
        for r in rows:
            if r["home"] == block:
                depth = -1 if before is None else shared(before, r["key"])
                cum = [0]
                for c in r["chars"]:
                    cum.append(cum[-1] + c)
                entries.append((Node(depth, r["ordinal"]), Node(r["len"], None, 1, r["conv_id"], 0, 1, 0, cum)))
            before = r["key"]
        return _table(contract(entries, last), block)

    return work


def _next_level(last: bool):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        entries: list[tuple[Node, Node | None]] = []
        for r in sorted(table.to_pylist(), key=lambda r: (r["block"], r["seq"])):
            node = Node(r["hi"], r["id"], r["n"], r["conv"], r["children"], r["leaves"], r["below"], r["cum"])
            if r["kind"] == "open":
                entries.append((node, None))
            else:
                entries[-1] = (entries[-1][0], node)
        return _table(contract(entries, last), key[0].as_py())

    return work


def _key(*more: Column) -> list[Column]:
    return [F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("z"), *more]


def rebuilt(conversations: DataFrame, every: int = EVERY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, z where conv_id is null, len) and their turns (c, z, pos, token, chars), each begun with the first turns of the base of its hundred."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    token = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.length(text).alias("chars"), token.alias("token"))
    turns = turns.select(*_key(F.col("turn"), F.col("role"), F.col("chars"), F.col("token")))
    turns = ordinal(turns, F.col("z"), F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("chars"), F.col("token")).drop("turn", "role")
    convs = cut(turns.groupBy("c", "z").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n")))
    name = F.when(F.col("z"), F.lit("")).otherwise(F.col("c").cast("string"))
    convs = convs.withColumn("h", F.when(F.col("z"), F.lit(0)).otherwise(F.crc32(name.cast("binary")) % most))
    bases = convs.where(~F.col("z") & (F.col("c") % every == 0)).select(F.col("c").alias("b"), F.col("n").alias("base_n"))
    convs = convs.withColumn("b", F.when(~F.col("z"), F.col("c") - F.col("c") % every)).join(bases, "b", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.select("c", "z", "b", "first", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    own = join_small(turns, convs.select("c", "z", "first", "h", "k"), ["c", "z"]).withColumn("at", F.col("ordinal") - F.col("first"))
    starts = own.where(~F.col("z") & (F.col("c") % every == 0) & (F.col("at") < most)).select(F.col("c").alias("b"), F.col("at").alias("pos"), "token", "chars")
    taken = convs.where("k > 0").select("c", "z", "b", "k").join(starts, "b").where("pos < k").select("c", "z", "pos", "token", "chars")
    rest = own.where("at >= h").select("c", "z", (F.col("k") + F.col("at") - F.col("h")).alias("pos"), "token", "chars")
    return convs.select("c", "z", "len"), cut(taken.unionByName(rest))


def _keys(convs: DataFrame, turns: DataFrame, first: int, grow: int) -> DataFrame:
    """Conversations with `key`, the tokens of their first `have` turns, and `chars`: as many as tell them from all others, or all they have."""

    def piece(lo: int, hi: int) -> DataFrame:
        some = turns.where(F.col("pos").between(lo, hi - 1)).groupBy("c", "z").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "chars"))).alias("t"))
        return some.select("c", "z", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["token"])), "")).alias("more"), F.transform("t", lambda x: x["chars"].cast("long")).alias("sizes"))

    none = F.array().cast("array<bigint>")
    rows = convs.join(piece(0, first), ["c", "z"], "left")
    rows = cut(rows.select("c", "z", "len", F.coalesce("more", F.lit(b"")).alias("key"), F.coalesce("sizes", none).alias("chars"), F.least("len", F.lit(first)).alias("have")))
    lo, hi = first, first * grow
    while True:
        alike = rows.where(f"len > {lo} and have = {lo}").groupBy("key").agg(F.count(F.lit(1)).alias("same")).where("same > 1").select("key")
        tied = cut(rows.where(f"len > {lo} and have = {lo}").join(alike, "key", "left_semi").select("c", "z"))
        if tied.isEmpty():
            return rows
        more = piece(lo, hi).join(tied, ["c", "z"], "left_semi")
        rows = rows.join(more, ["c", "z"], "left").select(
            "c", "z", "len", F.concat("key", F.coalesce("more", F.lit(b""))).alias("key"), F.concat("chars", F.coalesce("sizes", none)).alias("chars"), F.when(F.col("more").isNull(), F.col("have")).otherwise(F.least("len", F.lit(hi))).alias("have")
        )
        rows, lo, hi = cut(rows), hi, hi * grow


def _digests(ends: DataFrame) -> DataFrame:
    """id and ends_sha256 of the nodes that conversations end at; a node's ids are hashed as they come, none are held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, hashlib.sha256()
        for batch in batches:
            ids, found = [], []
            for node, conv in zip(batch.column("parent").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if node != at:
                    if at is not None:
                        ids.append(at), found.append(known.hexdigest())
                    at, known = node, hashlib.sha256()
                else:
                    known.update(b",")
                known.update(b"" if conv is None else b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["id", "ends"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([known.hexdigest()])], names=["id", "ends"])

    dealt = ends.select("parent", "conv").repartition("parent").sortWithinPartitions("parent", F.col("conv").asc_nulls_last())
    return dealt.mapInArrow(work, "id long, ends string")


def _intervals(rows: DataFrame, n: int, block: int, fan: int) -> tuple[DataFrame, int, list[str]]:
    """Rows of all levels, by kind, how many levels there were, and the folders that hold them; rows are conversations in order."""
    spark = rows.sparkSession
    blocks = max(1, -(-n // block))
    home = F.floor(F.col("ordinal") / block).cast("long")
    ends_block = F.col("ordinal") % block == block - 1
    near = rows.withColumn("home", home).withColumn("block", F.explode(F.when(ends_block, F.array(home, home + 1)).otherwise(F.array(home)))).where(F.col("block") < blocks)
    level, paths = near.groupBy("block").applyInArrow(_first_level(blocks == 1), _ROW), []
    while True:
        paths.append(shared_dir(spark, "trie"))
        level.write.partitionBy("kind").parquet(paths[-1])
        if blocks == 1:
            found = [spark.read.schema(_ROW).parquet(p) for p in paths]
            out = found[0]
            for x in found[1:]:
                out = out.unionByName(x)
            return out, len(paths), paths
        blocks = -(-blocks // fan)
        left = spark.read.schema(_ROW).parquet(paths[-1]).where(F.col("kind").isin("open", "item"))
        level = left.groupBy(F.floor(F.col("block") / fan).cast("long").alias("group")).applyInArrow(_next_level(blocks == 1), _ROW)


def trie(conversations: DataFrame, block: int = BLOCK, fan: int = FAN, first: int = FIRST, grow: int = GROW) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = conversations.sparkSession
    ship(spark)
    convs, turns = rebuilt(conversations)
    keys = _keys(convs, turns, first, grow)
    rows = ordinal(keys, F.col("key"), F.col("len"), F.col("z"), F.col("c")).select("ordinal", "key", "len", "chars", F.when(~F.col("z"), F.col("c")).alias("conv_id"))
    found, levels, paths = _intervals(rows, keys.count(), block, fan)
    same = found.where("kind = 'same'").select(F.col("id").alias("parent"), F.col("parent").alias("to"))

    def settled(df: DataFrame) -> DataFrame:
        """The parent that a part of a node went to, level by level."""
        for _ in range(levels - 1):
            df = join_small(df, same, ["parent"], "left").withColumn("parent", F.coalesce("to", "parent")).drop("to")
        return df

    if levels > 1:
        same = cut(same)
    digests = _digests(settled(found.where("kind = 'end'").select("parent", "conv")))
    nodes = cut(settled(found.where("kind = 'node'").select("id", "parent", "lo", "hi", "conv", "n", "children", "leaves", "below", "cum")).join(digests, "id", "left"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv"))
    leaves = settled(found.where("kind = 'leaf'").select("parent", "lo", "hi", "conv"))
    leaves = join_small(leaves, parents, ["parent"], "left")
    pieces = leaves.withColumn("from", F.explode(F.expr(f"sequence(lo, hi, {PIECE}L)"))).withColumn("depth", F.explode(F.expr(f"sequence(from, least(hi, from + {PIECE - 1}))")))
    here, ends = F.col("depth") == F.col("hi"), F.coalesce(F.col("conv").cast("string"), F.lit(""))
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("lo"), F.col("parent_conv")).otherwise(F.col("conv"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = pieces.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(here, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(here, F.sha2(ends.cast("binary"), 256)).otherwise(F.lit(NOBODY)).alias("ends_sha256"))
    deep = join_small(nodes, parents, ["parent"], "left").withColumn("depth", F.explode(F.sequence("lo", "hi")))
    spent = F.element_at("cum", -1) - F.element_at("cum", (F.greatest(F.col("depth") - 1, zero) - F.greatest(F.col("lo") - 1, zero) + 1).cast("int"))
    many = deep.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(here, F.col("children")).otherwise(one).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + (F.col("n") - 1) * spent).alias("saved_tokens"), F.when(here, F.coalesce("ends", F.lit(NOBODY))).otherwise(F.lit(NOBODY)).alias("ends_sha256"))
    out = cut(alone.unionByName(many))
    for path in paths:
        remove(spark, path)
    return out


def oracle(every: int = EVERY, most: int = MOST_SHARED) -> str:
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(s.conv_id::varchar, ''), ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"
    return f"""
    WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS crc),
    turn AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, length(text), tok) - 1 AS pos, tok, length(text) AS chars
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok FROM conversations)
    ),
    size AS (SELECT conv_id, count(*) AS n FROM turn GROUP BY conv_id),
    conv AS (
        SELECT s.conv_id, s.n, CASE WHEN s.conv_id IS NULL THEN 0 ELSE {crc} % {most} END AS h, b.conv_id AS base,
            least(CASE WHEN s.conv_id IS NULL THEN 0 ELSE {crc} % {most} END, coalesce(b.n, 0)) AS k
        FROM tab, size s LEFT JOIN size b ON b.conv_id = s.conv_id - s.conv_id % {every}
    ),
    made AS (
        SELECT c.conv_id, t.pos, tok, chars FROM conv c JOIN turn t ON t.conv_id = c.base WHERE t.pos < c.k
        UNION ALL SELECT c.conv_id, k + pos - h, tok, chars FROM conv c JOIN turn t ON t.conv_id IS NOT DISTINCT FROM c.conv_id WHERE pos >= h
    ),
    len AS (SELECT conv_id, k + greatest(n - h, 0) AS len FROM conv),
    member AS (
        SELECT conv_id, 0 AS d, '' AS path, 0 AS chars FROM len
        UNION ALL SELECT conv_id, pos + 1, string_agg(tok, '') OVER (PARTITION BY conv_id ORDER BY pos), chars FROM made
    ),
    up AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM member),
    node AS (SELECT path, d, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n, any_value(chars) AS chars FROM up GROUP BY path, d),
    child AS (SELECT up AS path, count(*) AS children FROM node WHERE d > 0 GROUP BY up),
    under AS (SELECT DISTINCT a.path, b.path AS low FROM member a JOIN member b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.d <= b.d),
    sums AS (
        SELECT under.path, count(*) FILTER (WHERE children IS NULL) AS leaves, sum((n - 1) * chars) AS saved
        FROM under JOIN node ON node.path = low LEFT JOIN child ON child.path = low GROUP BY under.path
    ),
    ends AS (SELECT path, string_agg(coalesce(CAST(m.conv_id AS VARCHAR), ''), ',' ORDER BY m.conv_id NULLS LAST) AS ids FROM member m JOIN len l ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND d = len GROUP BY path)
    SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(children, 0) AS n_children,
        CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM node JOIN sums USING (path) LEFT JOIN child USING (path) LEFT JOIN ends USING (path) LEFT JOIN node p ON node.d > 0 AND p.path = node.up
    """
