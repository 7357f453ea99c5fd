"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts are sets of five-word shingles, as 64-bit hashes. Equal sets are one class, so copies are
counted, never paired. A class's signature is a path of LONGEST minima in each of TREES trees; the
paths of a tree, sorted by their prefixes, are a trie. Two classes meet in a tree if their
leaves there are the same trie node, and a leaf's depth is set by the data:

    a prefix is matched first at the shortest depth, SHORTEST, where most nodes have few classes;
    a node with more than LIGHT classes is left for its longer prefixes, down to LONGEST minima;
    a class that has more long leaves than its recall allows shortens them: a pair at the
    threshold shares a leaf of depth d with probability threshold ** d, so the prefixes are
    shortened until 1 - prod(1 - threshold ** d) over the class's trees reaches the target,
    and a shortened node takes in all below it.

A leaf's size is seen only beyond LIGHT classes, so one partner more or less does not change a
class's depths, and the recall holds for every pair. Members of a leaf are compared with each
other, in blocks where a leaf is large, and nothing is compared beyond leaves: pairs whose sizes
or whose signatures (by six standard errors) exclude the threshold are dropped, and a pair that
meets in several trees is left to the first. What is left is verified on the texts themselves
by exact Jaccard similarity. Tasks return counts of links and a spanning forest of them, never the
pairs; near-duplicate classes are the components of the links.

Work is linear in the documents but for large leaves, whose members are all near each other: a
node of m classes takes m ** 2 / 2 comparisons of signatures, dealt over block pairs.

Defined cases: a null text is an empty one; texts without words are copies of each other; a text
of one to four words is one shingle. A null doc_id is a document like others; a class whose
doc_ids are all null has class_id null. Repeated rows are copies and count as links. Of rows that
tie in doc_id and text keep() takes the least hash of all columns, and one where these tie too.
A text is a set whatever its length, and one of its task's two blocks at a time. An empty table
gives no rows. Other columns may have any names; join() ignores them, keep() returns them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ROW_KEY, cut, join_small, one_each, row_key, ship, spread

WORDS = 5
THRESHOLD = 0.8
TREES = 24
SHORTEST, LONGEST = 4, 12
LIGHT = 32
RECALL = 0.999
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 1 << 20
TASK_CLASSES = 2048
_SPLIT = re.compile(rb"[^ \t-\r]+").findall
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def recall(depths: list[int], threshold: float = THRESHOLD) -> float:
    """The probability that a pair at the threshold shares a leaf in one of the trees at least."""
    return 1 - math.prod(1 - threshold**d for d in depths)


def allowed_depths(trees: int = TREES, threshold: float = THRESHOLD, target: float = RECALL) -> list[int]:
    """For k = 0, 1, ... trees with long leaves, the greatest depth of these at which a class reaches the target."""
    out = []
    for k in range(trees + 1):
        fits = [d for d in range(SHORTEST, LONGEST + 1) if recall([SHORTEST] * (trees - k) + [d] * k, threshold) >= target]
        out.append(max(fits, default=SHORTEST))
    return out


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = _SPLIT(text.encode())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * _A
        out ^= out >> np.uint64(29)
        out *= _B
        out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(x: np.ndarray, salts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One minimum over the set for each salted hash."""
    out = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(x), 256):
        np.minimum(out, (((x[lo : lo + 256, None] ^ salts) * factors)).min(0), out=out)
    return out


def signatures(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """doc_id, row key, class (128 bits of the shingle set), number of shingles and signature of every row.

    A signature is `trees` paths of LONGEST minima, two bytes each; that of no shingles is empty.
    """
    ship(docs.sparkSession)
    rng = np.random.default_rng(11)
    salts = rng.integers(0, 1 << 63, trees * LONGEST, dtype=np.uint64)
    factors = rng.integers(0, 1 << 63, trees * LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(x: np.ndarray) -> bytes:
        return ((minima(x, salts, factors) * _B) >> np.uint64(48)).astype("<u2").tobytes() if len(x) else b""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                names, sizes, signed = [], [], []
                for t in some.column("text"):
                    x = shingles(t.as_py())
                    names.append(xxhash.xxh3_128_digest(x.tobytes())), sizes.append(len(x)), signed.append(sign(x))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", *ROW_KEY)), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signed, pa.binary())], names=["doc_id", *ROW_KEY, "_class", "_n", "_sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return spread(rows).mapInArrow(work, "doc_id long, _r1 long, _r2 long, _r3 long, _class binary, _n long, _sig binary")


def _node(depth: Column | int) -> Column:
    """The name of the trie node at a depth of _path in tree t."""
    return F.xxhash64("t", F.substring("_path", F.lit(1), 2 * F.lit(depth)))


def leaves(classes: DataFrame, trees: int = TREES, threshold: float = THRESHOLD, target: float = RECALL, light: int = LIGHT) -> DataFrame:
    """_class, t, depth and label (the trie node) of each leaf of a class that may hold another class; classes has _class and _sig."""
    path = F.expr(f"transform(sequence(0, {trees - 1}), t -> substring(_sig, {2 * LONGEST} * t + 1, {2 * LONGEST}))")
    paths = classes.where(F.length("_sig") > 0).select("_class", F.posexplode(path).alias("t", "_path")).withColumn("label", _node(SHORTEST))
    nodes = cut(paths.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    met = cut(join_small(paths, nodes, ["label"]))
    few = met.where(F.col("m") <= light).select("_class", "t", F.lit(SHORTEST).alias("depth"), "label")
    many = met.where(F.col("m") > light).select("_class", "t", "_path")
    below = many.withColumn("d", F.explode(F.sequence(F.lit(SHORTEST + 1), F.lit(LONGEST)))).withColumn("label", _node(F.col("d")))
    heavy = cut(below.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > light).select("label"))
    last = join_small(below, heavy, ["label"]).groupBy("_class", "t").agg(F.max("d").alias("last"))
    deep = many.join(last, ["_class", "t"], "left").select("_class", "t", "_path", F.least(F.lit(LONGEST), F.coalesce("last", F.lit(SHORTEST)) + 1).alias("depth"))
    may = F.get(F.array(*map(F.lit, allowed_depths(trees, threshold, target))), F.col("k"))
    deep = cut(deep.join(deep.groupBy("_class").agg(F.count(F.lit(1)).cast("int").alias("k")), "_class").withColumn("may", may).drop("k"))
    asked = cut(deep.where("may < depth").select(_node(F.col("may")).alias("label")).distinct())
    above = deep.withColumn("d", F.explode(F.sequence(F.lit(SHORTEST), F.col("depth") - 1))).withColumn("label", _node(F.col("d")))
    shorter = join_small(above.select("_class", "t", "d", "label"), asked, ["label"]).groupBy("_class", "t").agg(F.min("d").alias("d"))
    deep = deep.join(shorter, ["_class", "t"], "left").withColumn("depth", F.coalesce("d", "depth")).withColumn("label", _node(F.col("depth")))
    return few.unionByName(deep.select("_class", "t", "depth", "label"))


def _contract(edges: DataFrame) -> DataFrame:
    """Edges between the same components, every neighbour of a vertex tied to the vertex's least neighbour instead.

    In a dense component, where vertices share their least neighbours, one edge or so a vertex is left."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v and the least vertex comp of its component, for every vertex of edges (a, b).

    Edges are contracted twice; then least labels pass along what is left, and labels jump to their label's
    label, until nothing changes. Every round is checkpointed, nothing is collected.
    """
    edges = cut(_contract(cut(_contract(edges.select("a", "b")))))
    both = cut(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = label.join(near.select(F.col("a").alias("v"), "m"), "v").select("v", F.least("comp", "m").alias("c1"), F.col("comp").alias("old"))
        jump = label.select(F.col("v").alias("c1"), F.col("comp").alias("c2"))
        after = cut(step.join(jump, "c1", "left").select("v", F.least("c1", F.coalesce("c2", "c1")).alias("comp"), "old"))
        if after.where("comp <> old").isEmpty():
            return after.select("v", "comp")
        label = after.select("v", "comp")


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each two of the sets are similar, exactly, as a square matrix."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(m), sizes)
    often = np.bincount(column)[column] > 1
    column, row = np.unique(column[often], return_inverse=True)[1], row[often]
    shared = np.zeros((m, m))
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = max(256, (1 << 22) // m)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((m, min(width, int(column[b - 1]) - lo + 1)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        shared += part @ part.T
    return shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6


def likely(sizes: np.ndarray, labels: np.ndarray, sigs: np.ndarray, tree: int, split: int | None, threshold: float) -> np.ndarray:
    """Upper matrix of the pairs of a leaf that size and signature allow and that meet in no earlier tree; with split, only pairs across it."""
    m, width = len(sizes), sigs.shape[1]
    pairs = np.triu(np.ones((m, m), bool), 1)
    if split is not None:
        pairs[:split, :split] = pairs[split:, split:] = False
    pairs &= np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes) - 1e-6
    least = width * (threshold - 6 * math.sqrt(threshold * (1 - threshold) / width))
    i, j = np.nonzero(pairs)
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 14):
        a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
        near = (sigs[a] == sigs[b]).sum(1) >= least
        met = (labels[a, :tree] == labels[b, :tree]) & (labels[a, :tree] != 0)
        keep[lo : lo + (1 << 14)] = near & ~met.any(1)
    pairs[i[~keep], j[~keep]] = False
    return pairs


def _forest(m: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if (x := find(a)) != (y := find(b)):
            root[y] = x
            out.append((a, b))
    return out


def _runs(*keys: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    held = list(zip(*(k.to_pylist() for k in keys), strict=True))
    lo = 0
    for hi in range(1, len(held) + 1):
        if hi == len(held) or held[hi] != held[lo]:
            yield lo, hi
            lo = hi


def _units(classes: DataFrame, met: DataFrame, trees: int, threshold: float) -> DataFrame:
    """The members of leaves, or of pairs of their blocks, with the pairs to verify: unit, place, partners (bits of places), and the class's columns."""
    by_tree = F.map_from_entries(F.collect_list(F.struct("t", "label")))
    held = met.groupBy("_class").agg(by_tree.alias("_at")).select("_class", F.expr(f"transform(sequence(0, {trees - 1}), t -> coalesce(element_at(_at, t), 0L))").alias("labels"))
    held = cut(held.join(classes.select("_class", "_n", "copies", "_sig"), "_class"))
    members = held.select("*", F.posexplode("labels").alias("t", "label")).where("label <> 0")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("_n").alias("s")).where("m > 1")
    sizes = cut(sizes.select("label", F.ceil(F.greatest(F.col("m") / BLOCK_CLASSES, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"), "m"))
    tasks = max(1, (sizes.agg(F.sum("m")).first()[0] or 0) // TASK_CLASSES)
    members = join_small(members, sizes, ["label"])
    members = members.withColumn("mine", F.pmod(F.xxhash64("_class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("label", "t", "_class", "_n", "copies", "labels", "_sig", "mine", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "blocks")
    members = members.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(tasks))).otherwise(F.xxhash64("label", "bi", "bj"))).drop("blocks")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ("label", "bi", "bj", "mine", "_class")])
        sizes, mine, tree = (rows.column(c).to_numpy() for c in ("_n", "mine", "t"))
        labels = np.array(rows.column("labels").to_pylist(), np.int64)
        sigs = np.frombuffer(b"".join(rows.column("_sig").to_pylist()), "<u2").reshape(len(sizes), -1)
        bi, bj = rows.column("bi").to_numpy(), rows.column("bj").to_numpy()
        take, unit, place, bits = [], [], [], []
        for lo, hi in _runs(rows.column("label"), rows.column("bi"), rows.column("bj")):
            split = None if bi[lo] == bj[lo] else int((mine[lo:hi] == bi[lo]).sum())
            pairs = likely(sizes[lo:hi], labels[lo:hi], sigs[lo:hi], int(tree[lo]), split, threshold)
            used = np.flatnonzero(pairs.any(0) | pairs.any(1))
            name = xxhash.xxh3_64_intdigest(labels[lo, tree[lo]].tobytes() + bytes(f"{bi[lo]}/{bj[lo]}", "ascii")) - (1 << 63)
            for k, x in enumerate(used.tolist()):
                take.append(lo + x), unit.append(name), place.append(k), bits.append(np.packbits(pairs[x, used]).tobytes())
        some = rows.take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(some.column(c).combine_chunks() for c in ("_class", "_n", "copies")), pa.array(unit, pa.int64()), pa.array(place, pa.int32()), pa.array(bits, pa.binary())], names=["_class", "_n", "copies", "unit", "place", "partners"])

    return members.groupBy("task").applyInArrow(look, "_class binary, _n long, copies long, unit long, place int, partners binary")


def link(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = RECALL, light: int = LIGHT) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has doc_id, row key and _class of every row of docs; classes has, for every _class,
    its copies, its first row (least doc_id, then hashes), its component comp, and links, the number of documents of other classes it is similar to."""
    sig = cut(signatures(docs, trees))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", *ROW_KEY))
    classes = cut(sig.groupBy("_class").agg(F.count(F.lit(1)).alias("copies"), first.alias("first"), F.max("_n").alias("_n"), F.any_value("_sig").alias("_sig")))
    units = cut(_units(classes, leaves(classes.select("_class", "_sig"), trees, threshold, target, light), trees, threshold))
    wanted = cut(units.select("_class").distinct().join(classes, "_class").select("_class", "first.*").drop("z", "doc_id"))
    texts = docs.select(*row_key(docs), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = join_small(texts, wanted, ROW_KEY).groupBy("_class").agg(F.any_value("text").alias("text"))
    tasks = max(1, (units.agg(F.sum("_n")).first()[0] or 0) // BLOCK_SHINGLES)
    placed = units.join(texts, "_class").withColumn("task", F.pmod("unit", F.lit(tasks)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by([("unit", "ascending"), ("place", "ascending")])
        name, text, partners = rows.column("_class").to_pylist(), rows.column("text"), rows.column("partners").to_pylist()
        copies = rows.column("copies").to_numpy()
        a, b, n = [], [], []
        for lo, hi in _runs(rows.column("unit")):
            m = hi - lo
            pairs = np.unpackbits(np.frombuffer(b"".join(partners[lo:hi]), np.uint8).reshape(m, -1), axis=1, count=m).astype(bool)
            i, j = np.nonzero(pairs & similar([shingles(text[k].as_py()) for k in range(lo, hi)], threshold))
            weight = np.zeros(m, np.int64)
            np.add.at(weight, i, copies[lo:hi][j])
            np.add.at(weight, j, copies[lo:hi][i])
            for k in np.flatnonzero(weight).tolist():
                a.append(name[lo + k]), b.append(None), n.append(int(weight[k]))
            for x, y in _forest(m, i, j):
                a.append(name[lo + x]), b.append(name[lo + y]), n.append(0)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    links = cut(placed.groupBy("task").applyInArrow(verify, "a binary, b binary, n long"))
    linked = links.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).select(F.col("a").alias("_class"), "links")
    comp = components(links.where("b is not null").select("a", "b")).select(F.col("v").alias("_class"), "comp")
    classes = classes.select("_class", "copies", "first").join(comp, "_class", "left").join(linked, "_class", "left")
    return sig.select("doc_id", *ROW_KEY, "_class"), classes.select("_class", "copies", "first", F.coalesce("comp", "_class").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"))


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (least doc_id of its near-duplicate class), copy_of (least doc_id with the same shingles) and
    n_links (other documents at or above the threshold, copies included) of every row of docs."""
    rows, classes = link(docs, **options)
    classes = cut(classes)
    heads = cut(classes.groupBy("comp").agg(F.min("first.doc_id").alias("class_id"), F.count(F.lit(1)).alias("m")))
    alone, more = heads.where("m = 1"), cut(heads.where("m > 1").drop("m"))  # most components are one class
    columns = ["_class", "class_id", F.col("first.doc_id").alias("copy_of"), (F.col("links") + F.col("copies") - 1).alias("n_links")]
    named = join_small(classes, more, ["comp"]).select(*columns).union(classes.join(alone, "comp").select(*columns))
    return rows.join(named, "_class").select("doc_id", "class_id", "copy_of", "n_links")


def keep(docs: DataFrame, **options) -> DataFrame:
    """One row of docs, all columns, of each near-duplicate class: the first by doc_id (nulls last), then hashes."""
    rows, classes = link(docs, **options)
    kept = classes.groupBy("comp").agg(F.min("first").alias("first")).select(*(f"first.{k}" for k in ROW_KEY))
    alike = rows.groupBy(*ROW_KEY).agg(F.count(F.lit(1)).alias("_same"))
    return one_each(docs, cut(kept.join(alike, ROW_KEY))).select("_doc.*")


def oracle(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, over the view documents: shared shingles of all pairs, and components by recursion."""
    return f"""with recursive d as (select row_number() over () as id, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') as w from documents),
g as (select id, unnest(case when len(w) >= {WORDS} then list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
n as (select id, count(*) as n, sum(hash(s)::hugeint) as h from g group by id),
c as (select d.id, doc_id, coalesce(n, 0) as n, coalesce(h, 0) as h, min(d.id) over (partition by coalesce(n, 0), coalesce(h, 0)) as k, min(doc_id) over (partition by coalesce(n, 0), coalesce(h, 0)) as copy_of, count(*) over (partition by coalesce(n, 0), coalesce(h, 0)) as copies from d left join n on n.id = d.id),
f as (select k, n, copies, copy_of from c where id = k),
x as (select g.id as k, s from g semi join f on f.k = g.id),
p as (select a.k as a, b.k as b, count(*) as shared from x a join x b on a.s = b.s and a.k <> b.k group by a.k, b.k),
e as (select p.a, p.b, fb.copies from p join f fa on fa.k = p.a join f fb on fb.k = p.b where shared >= {threshold} * (fa.n + fb.n - shared) - 1e-6),
r as (select k as a, k as b from f union select r.a, e.b from r join e on r.b = e.a),
m as (select r.a as k, min(f.copy_of) as class_id from r join f on f.k = r.b group by r.a),
l as (select a as k, sum(copies) as links from e group by a)
select c.doc_id, m.class_id, c.copy_of, (c.copies - 1 + coalesce(l.links, 0))::bigint as n_links from c join m on m.k = c.k left join l on l.k = c.k"""
