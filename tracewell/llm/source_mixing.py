"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. Within its source the documents are in the order of
their keys, cut into buckets by the key's leading digits; prefix sums of bucket sizes, then of
documents inside a bucket, say where each document stands, and the source is cut at exactly
its budget of words. Budgets above the source's size repeat whole epochs first.

No group grows with the data: a bucket holds about `bucket_rows` different documents of one source,
whatever the source's share, and bucket totals are one row a bucket. Rows that are alike in all
columns are counted before they are dealt, and follow each other in the order.

Defined cases: null and empty texts have size 0 and are never taken. A null source is a source,
last in order. Repeated rows are separate rows and interchangeable; ties of the key (one doc_id and
text) are ordered by the hash of the whole row. If all sizes are 0 all targets are 0. A very long text
is one size; the budget may end inside it. An empty table gives no rows. Other columns may have any
names and types, maps too: plan() ignores them, mix() returns them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import ROW_KEY, column, cut, one_each, row_key, spread, words

WEIGHTS = (1, 2, 3)
MOST = 3
BUCKET_ROWS = 2000
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size (and more) -> and target: by weight, none above `most` times the source's size.

    The sources that reach their bound are those with the least bound per weight; in that order
    level = (total - bounds before) / (weights from here on), and the first level that the
    source at hand can take in full is what every open source gets per weight.
    One row a source, so the windows here are over sources, not documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("_cap", most * F.col("source_size").cast("double"))
    by = W.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before, after, whole = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    ranked = ranked.withColumn(
        "_level",
        (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after),
    )
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("l")))).over(whole)
    return ranked.withColumn("target", F.least(F.col("_cap"), level["l"] * F.col("_w"))).select(*sizes.columns, "target")


def _times(df: DataFrame, n: str, to: str, piece: int = 4096) -> DataFrame:
    """Every row of df n times, numbered from 0 in column to; no array has more than about sqrt(n) or `piece` entries."""
    df = df.withColumn("_k", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {piece})")))
    return df.withColumn(to, F.explode(F.expr(f"sequence(_k * {piece}, least({n}, (_k + 1) * {piece}) - 1)"))).drop("_k")


def _placed(docs: DataFrame, seed: int, weights: tuple[int, ...], most: int, bucket_rows: int) -> DataFrame:
    """One row for all rows alike: their number m, source, doc_id, size, target, where the first of them stands, and the row key.

    Sizes and keys, about a hundred bytes a document, are checkpointed: texts are read once.
    """
    rows = spread(docs).select(column("doc_id").alias("doc_id"), column("source").alias("source"), F.size(words(column("text"))).cast("long").alias("size"), draw(seed).alias("_key"), *row_key(docs))
    rows = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    aims = targets(sizes, weights, most).select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.floor("target").cast("long").alias("_budget"),
        F.greatest(F.lit(1), F.least(F.lit(1 << 28), F.ceil(F.col("_rows") / bucket_rows))).cast("long").alias("_buckets"),
        F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("_sid"),
    )
    aims = cut(aims)
    placed = rows.join(F.broadcast(aims) if aims.count() <= BROADCAST_SOURCES else aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("_bucket", F.expr("shiftright(cast(conv(substring(_key, 1, 8), 16, 10) as bigint) * _buckets, 32)"))
    ahead = W.partitionBy("_sid").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_sid", "_bucket").agg(F.sum(F.col("size") * F.col("m")).alias("_sum")).select("_sid", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    placed = placed.join(totals, ["_sid", "_bucket"])
    inside = W.partitionBy("_sid", "_bucket").orderBy("_key", *ROW_KEY).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_ahead") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0))
    epochs = F.expr("case when source_size > 0 then _budget div source_size else 0L end")
    return placed.select("*", before.alias("_before"), epochs.alias("_epochs"), (F.col("_budget") - epochs * F.col("source_size")).alias("_rest"))


def plan(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of docs."""
    each = _times(_placed(docs, seed, weights, most, bucket_rows), "m", "_copy")
    before = F.col("_before") + F.col("_copy") * F.col("size")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - before))
    return each.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def draw(seed: int):
    """The hash-random key of a row, as hexadecimal text: from the seed, doc_id and text."""
    text = F.md5(F.coalesce(column("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(column("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))


def mix(docs: DataFrame, seed: int = 7, cut_texts: bool = True, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs, all columns, with every row repeated as often as the mix takes it whole; where a source's
    budget ends inside a document, one more copy holds its words up to there, joined by single spaces.
    Without cut_texts that copy is whole, and the source's budget is exceeded by less than a document."""
    placed = _placed(docs, seed, weights, most, bucket_rows)
    all_ = F.col("m") * F.col("size")
    taken = F.col("_epochs") * all_ + F.greatest(F.lit(0), F.least(all_, F.col("_rest") - F.col("_before")))
    wanted = placed.select(*ROW_KEY, F.col("m").alias("_same"), "size", taken.cast("long").alias("_taken")).where("_taken > 0")
    wanted = cut(wanted.withColumn("_copies", F.expr("(_taken + size - 1) div size")))
    rows = _times(one_each(docs, wanted), "_copies", "_copy")
    if not cut_texts:
        return rows.select("_doc.*")
    left = F.col("_taken") - F.col("_copy") * F.col("size")
    short = F.array_join(F.slice(words(F.col("_doc.text")), F.lit(1), F.greatest(left, F.lit(1)).cast("int")), " ")
    return rows.select(F.when(left < F.col("size"), F.col("_doc").withField("text", short)).otherwise(F.col("_doc")).alias("_doc")).select("_doc.*")


def oracle(seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> str:
    """The same in DuckDB SQL, over the view documents."""
    return f"""with d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> ''))::bigint as size,
  md5('{seed}|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, ([{', '.join(f'{w}.0::double' for w in weights)}])[(row_number() over (order by source nulls last) - 1) % {len(weights)} + 1] as w from s),
c as (select *, {most} * source_size::double as cap from r),
v as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from c),
t as (select source, source_size, least(cap, w * (select arg_min(level, cap / w) from v where level * w <= cap)) as target from v),
p as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget,
  coalesce(sum(d.size) over (partition by t.source order by d.key rows between unbounded preceding and 1 preceding), 0) as before from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when source_size > 0 then (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) else 0 end)::bigint as taken from p"""
