"""The explorer's aggregates over posts, connections and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.dates import js_round
from tracewell.functions.text import hashtags
from tracewell.operators.activity import top


def comments_per_post(months: DataFrame, n: int = 6) -> DataFrame:
    """month and ratio, to one decimal, of the last months with posts, from month, posts, comments."""
    last = months.where("posts > 0").orderBy(F.desc("month")).limit(n)
    return last.select("month", (js_round(F.col("comments") / F.col("posts") * 10) / 10).alias("ratio"))


def visible(rows: DataFrame, field: str) -> DataFrame:
    """Rows, those whose field is not blank, and their whole percent."""
    seen = F.count_if(F.trim(F.coalesce(field, F.lit(""))) != "")
    return rows.agg(F.count(F.lit(1)).alias("rows"), seen.alias("visible")).select("rows", "visible", F.expr("100 * visible div greatest(rows, 1)").alias("percent"))


def histogram(rows: DataFrame, field: str) -> DataFrame:
    """Rows by value, blank ones as ?."""
    return rows.groupBy(F.coalesce(F.nullif(field, F.lit("")), F.lit("?")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def posts_by(rows: DataFrame, by: str, text: str, marked: Column) -> DataFrame:
    """Rows of each value of `by`, the whole mean length of their texts, and the whole percent that is marked."""
    of = rows.select(F.col(by), F.length(text).cast("long").alias("_length"), marked.alias("_marked")).groupBy(by)
    return of.agg(F.count(F.lit(1)).alias("n"), F.expr("sum(_length) div greatest(count(1), 1)").alias("mean_length"), F.expr("100 * count_if(_marked) div greatest(count(1), 1)").alias("percent"))


def one_sided(rows: DataFrame, key: str, sent: Column, got: Column) -> DataFrame:
    """One row: keys that were only written to (ghosts) and keys that only wrote (fans)."""
    sides = rows.groupBy(key).agg(F.coalesce(F.bool_or(sent), F.lit(False)).alias("s"), F.coalesce(F.bool_or(got), F.lit(False)).alias("g"))
    return sides.where(F.col(key).isNotNull()).agg(F.count_if(F.col("s") & ~F.col("g")).alias("ghosts"), F.count_if(F.col("g") & ~F.col("s")).alias("fans"))


def comments_by_post(rows: DataFrame, post: str) -> DataFrame:
    """One row: comments, the posts they are on, and the most on one."""
    each = rows.groupBy(post).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("comments"), F.count(F.lit(1)).alias("posts"), F.max("n").alias("most"))


def top_hashtags(rows: DataFrame, text: str, n: int = 10) -> DataFrame:
    """tag and n of the hashtags written most often, every use counting; ties go by the tag."""
    tags = rows.select(F.explode(hashtags(F.col(text))).alias("tag"))
    return top(tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "n", ["tag"], n)


def initiated(messages: DataFrame) -> DataFrame:
    """Conversations, and those whose last row of the file, the earliest message, is the self's."""
    first = messages.groupBy("conv").agg(F.max_by("is_self", "row_idx").alias("mine"))
    return first.agg(F.count(F.lit(1)).alias("conversations"), F.count_if("mine").alias("initiated"))


def top_sides(messages: DataFrame, n: int = 6) -> DataFrame:
    """direction, name, n and first_idx of the senders and recipients of most messages; a message to several people counts for no recipient.

    messages has row_idx, is_self, sender and recipients, names joined by commas. Ties go by the first row.
    """
    side = lambda rows, name, direction: rows.select(F.trim(name).alias("name"), "row_idx").where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_idx")).select(F.lit(direction).alias("direction"), "*")
    out = side(messages.where("is_self and not contains(recipients, ',')"), "recipients", "outbound")
    return top(out, "n", ["first_idx"], n).unionByName(top(side(messages.where("not is_self"), "sender", "inbound"), "n", ["first_idx"], n))
