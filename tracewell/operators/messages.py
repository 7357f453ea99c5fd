"""Counts over a messages export: rows left out, messages by month, totals of a range, who never answered.

rows has row_idx and ts (null where undated); people or events have a row for each message and person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.dates import month_key
from tracewell.operators.people import range_start


def most_frequent(rows: DataFrame, key: str, order: str = "row_idx") -> DataFrame:
    """One row: the key of most rows, of ties the one seen first; null where there is none."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f"))
    return counts.agg(F.max_by(key, F.struct("n", -F.col("f"))).alias(key))


def skipped(rows: DataFrame, people: DataFrame) -> DataFrame:
    """One row: messages without a time, those with one that name nobody, and both together."""
    named = people.select("row_idx", F.lit(True).alias("named")).distinct()
    facts = rows.join(named, "row_idx", "left").agg(F.count_if(F.col("ts").isNull()).alias("undated"), F.count_if(F.col("ts").isNotNull() & F.col("named").isNull()).alias("nobody"))
    return facts.withColumn("skipped", F.col("undated") + F.col("nobody"))


def window(rows: DataFrame, key: str = "12m") -> DataFrame:
    """The first and the last month of a range as one row of dates; no row where the range or the file has no start."""
    return range_start(rows, key).crossJoin(F.broadcast(rows.agg(F.trunc(F.max("ts").cast("date"), "month").alias("end")))).where("start is not null")  # of one row each


def monthly(rows: DataFrame, key: str = "12m") -> DataFrame:
    """month and n of every month of the range, 0 where nothing was written."""
    months = window(rows, key).select(F.explode(F.expr("sequence(start, end, interval 1 month)")).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    counts = rows.where("ts is not null").groupBy(month_key(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return months.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def range_totals(events: DataFrame, key: str = "12m") -> DataFrame:
    """One row: people, mentions of people and distinct messages within the range."""
    rows = events.crossJoin(F.broadcast(range_start(events, key))).where("start is null or ts >= start")  # one row
    by_row = rows.groupBy("row_idx").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum("k"), F.lit(0)).alias("mentions"))
    return by_row.crossJoin(F.broadcast(rows.select("contact").distinct().agg(F.count(F.lit(1)).alias("people"))))


def unanswered(sides: DataFrame) -> DataFrame:
    """One row: contacts that were written to and never wrote, from contact and is_self (who wrote)."""
    by = sides.groupBy("contact").agg(F.bool_or("is_self").alias("sent"), F.bool_or(~F.col("is_self")).alias("received"))
    return by.agg(F.count_if(F.col("sent") & ~F.col("received")).alias("unanswered_contacts"))
