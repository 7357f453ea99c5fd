"""Connections, contacts, relationships, outreach and recent threads.

Messages tables have row_idx (order in the file), conv, ts and participants; every first-seen
rule goes by row_idx, never by the order rows happen to arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.constants import ANONYMOUS, RANGE_DAYS, RANGE_MONTHS
from tracewell.functions.dates import days_since, js_round
from tracewell.operators.ordinal import in_file_order, numbered
from tracewell.operators.stored import stored


def month_counts(rows: DataFrame, ts: str) -> DataFrame:
    """Rows by month, months between without rows being 0."""
    counts = rows.where(F.col(ts).isNotNull()).groupBy(F.trunc(F.col(ts).cast("date"), "month").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a is not null")
    months = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("d"))
    return months.join(counts, "d", "left").select(F.date_format("d", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def months_as_written(rows: DataFrame, column: str) -> DataFrame:
    """Rows by the first two parts of a date as text; no date is checked, texts without two parts are left out."""
    part = lambda k: F.coalesce(F.get(F.split(F.col(column), "-"), F.lit(k)), F.lit(""))
    rows = rows.where((part(0) != "") & (part(1) != "")).groupBy(F.concat_ws("-", part(0), part(1)).alias("month"))
    return rows.agg(F.count(F.lit(1)).alias("n"))


def connection_stats(rows: DataFrame, ts: str, now: str) -> DataFrame:
    age = F.greatest(F.lit(0.0), F.floor(F.datediff(F.lit(now).cast("date"), F.min(F.col(ts)).cast("date")) / 30.44 + 0.5)).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(age, F.lit(0)).alias("age_months"))


def in_range(rows: DataFrame, ts: str, key: str, now: str) -> DataFrame:
    """Rows of the last days of a range before now; undated ones only where nothing is filtered."""
    return rows.where(F.col(ts) >= F.date_sub(F.lit(now).cast("date"), RANGE_DAYS[key])) if key in RANGE_DAYS else rows


def top_values(rows: DataFrame, field: str, n: int = 10, order: str = "row_idx") -> DataFrame:
    """The most frequent non-blank values; ties by first appearance."""
    counts = rows.where(F.trim(F.coalesce(field, F.lit(""))) != "").groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_idx"))
    return counts.orderBy(F.desc("n"), "first_idx").limit(n)


def mode(rows: DataFrame, field: str, order: str = "row_idx") -> DataFrame:
    """The value that first reaches the largest count."""
    counts = rows.where(F.trim(F.coalesce(field, F.lit(""))) != "").groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last_idx"))
    return counts.orderBy(F.desc("n"), "last_idx").limit(1).select("value", "n")


def participants(rows: DataFrame, sender: Column, sender_url: Column, names: Column, urls: Column) -> DataFrame:
    """row_idx and all other columns, with a row for each participant: role, name, url. Recipients are zipped by address, names by place."""
    fallback = lambda i: F.coalesce(F.nullif(F.get(names, i), F.lit("")), F.get(names, F.lit(0)), F.lit(""))
    zipped = F.when(F.size(urls) > 0, F.transform(urls, lambda u, i: F.struct(F.lit("to").alias("role"), fallback(i).alias("name"), u.alias("url"))))
    zipped = zipped.otherwise(F.transform(names, lambda n: F.struct(F.lit("to").alias("role"), n.alias("name"), F.lit("").alias("url"))))
    one = F.array(F.struct(F.lit("from").alias("role"), sender.alias("name"), sender_url.alias("url")))
    out = rows.select("*", F.explode(F.concat(one, zipped)).alias("_p")).select("*", "_p.role", "_p.name", "_p.url").drop("_p")
    return out.where(((F.col("name") != "") | (F.col("url") != "")) & (F.lower("name") != ANONYMOUS)).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown")))


def own_key(key: str) -> Column:
    """A join key in which blanks are all different and equal to nothing, so that they are no hot key."""
    return F.when(F.coalesce(F.col(key), F.lit("")) == "", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col(key))


def canonical_contacts(people: DataFrame) -> DataFrame:
    """people (row_idx, name_key, url, ...) with contact: the address, or the one last seen with the same name, or the name.

    A person whom a message names more than once is one participant of it: the first by role, address and name.
    """
    by_name = people.where((F.col("url") != "") & (F.col("name_key") != "")).groupBy("name_key").agg(F.max_by("url", "row_idx").alias("_known")).withColumnRenamed("name_key", "_own")
    url = F.coalesce(F.nullif("url", F.lit("")), F.col("_known"), F.lit(""))
    key = F.when(url != "", F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("name:"), "name_key"))
    named = people.withColumn("_own", own_key("name_key")).join(by_name, "_own", "left").withColumn("contact", key)
    rest = [c for c in people.columns if c != "row_idx"]
    first = F.min_by(F.struct(*rest), F.struct(*([F.col("role")] if "role" in rest else []), (F.col("url") == "").alias("z"), "url", "name_key", *(["name"] if "name" in rest else [])))
    return named.groupBy("row_idx", "contact").agg(first.alias("_p")).select("row_idx", "_p.*", "contact")


def contacts(events: DataFrame) -> DataFrame:
    """Messages, last time, latest name and first address of each contact."""
    return events.groupBy("contact").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.max_by("name", "row_idx").alias("name"), F.min_by("url", "row_idx").alias("url"))


def range_start(events: DataFrame, key: str) -> DataFrame:
    """One row: the first day of the range's first month, counted back from the latest message; null for no range."""
    months = RANGE_MONTHS.get(key)
    start = F.add_months(F.trunc(F.max("ts").cast("date"), "month"), 1 - months) if months else F.lit(None).cast("date")
    return events.agg(start.alias("start"))


def top_contacts(events: DataFrame, key: str = "12m", n: int = 10) -> DataFrame:
    """The contacts with most messages of a range; ties go by the last time, then by the latest name, before the list is cut."""
    rows = events.crossJoin(F.broadcast(range_start(events, key))).where("start is null or ts >= start")
    counts = rows.groupBy("contact").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    named = counts.join(events.groupBy("contact").agg(F.max_by("name", "row_idx").alias("_name")), "contact")
    return named.orderBy(F.desc("n"), F.desc("last_ts"), "_name", "contact").limit(n).drop("_name")


def with_people(counts: DataFrame, people: DataFrame) -> DataFrame:
    """counts (contact, ...) with name and url of the contact; Unknown and blank where people does not have it."""
    rows = counts.join(people.select("contact", "name", "url"), "contact", "left")
    return rows.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown"))).withColumn("url", F.coalesce("url", F.lit("")))


def first_rows(rows: DataFrame, key: str, order: str = "row_idx") -> DataFrame:
    """The first row of each non-blank key."""
    ranked = rows.where(F.col(key) != "").withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return ranked.where("_r = 1").drop("_r")


def match_connections(people: DataFrame, connections: DataFrame) -> DataFrame:
    """people (url, name_key, ...) with connection: the row_idx of the first connection with the address, else with the name."""
    by_url = first_rows(connections, "url").select(F.col("url").alias("_own"), F.col("row_idx").alias("_u"))
    by_name = first_rows(connections, "name_key").select(F.col("name_key").alias("_own"), F.col("row_idx").alias("_n"))
    rows = people.withColumn("_own", own_key("url")).join(by_url, "_own", "left").withColumn("_own", own_key("name_key")).join(by_name, "_own", "left")
    return rows.withColumn("connection", F.coalesce("_u", "_n")).drop("_u", "_n", "_own")


def silent(connections: DataFrame, talked_urls: DataFrame, talked_names: DataFrame) -> DataFrame:
    """Connections whose address and name never occur among messages; two anti joins, so that neither needs a nested loop. Blanks match nothing."""
    by = lambda rows, talked, key: rows.withColumn("_own", own_key(key)).join(talked.where(F.col(key) != "").select(F.col(key).alias("_own")), "_own", "left_anti")
    return by(by(connections, talked_urls, "url"), talked_names, "name_key").select(*connections.columns)


def fading(contact_rows: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Contacts with a connection that have been quiet for the days before now."""
    rows = contact_rows.where("connection is not null").withColumn("days_since", days_since(F.lit(now).cast("timestamp_ntz"), F.col("last_ts")))
    return rows.where(F.col("days_since") >= days)


def conversations(messages: DataFrame) -> DataFrame:
    """conv, whether the self started it, and whether another one answered, from conv, ts, row_idx, is_self (null: nobody known)."""
    mine = F.coalesce("is_self", F.lit(False))
    return messages.groupBy("conv").agg(F.min_by(mine, F.struct("ts", "row_idx")).alias("started_by_self"), F.bool_or(F.coalesce(~F.col("is_self"), F.lit(False))).alias("got_reply"))


def outreach(messages: DataFrame) -> DataFrame:
    """The outreach funnel, one row."""
    facts = conversations(messages).agg(
        F.count(F.lit(1)).alias("conversations"),
        F.count_if("started_by_self").alias("self_initiated"),
        F.count_if(~F.col("started_by_self")).alias("others_initiated"),
        F.count_if(F.col("started_by_self") & F.col("got_reply")).alias("replied"),
    )
    sides = messages.agg(F.count_if("is_self").alias("sent"), F.count_if(~F.col("is_self")).alias("received"))
    rows = facts.crossJoin(sides)
    return rows.withColumn("reply_rate", F.try_divide("replied", "self_initiated")).withColumn("sent_received_ratio", F.try_divide("sent", "received"))


def self_stats(people: DataFrame, key: str) -> DataFrame:
    """Per key: total, as sender, as recipient, distinct conversations, first row."""
    return people.where(F.col(key) != "").groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("role") == "from").alias("sender"), F.count_if(F.col("role") == "to").alias("recipient"), F.countDistinct("conv").alias("convs"), F.min("row_idx").alias("first_idx")
    )


def pick_self(stats: DataFrame) -> DataFrame:
    """The key that is the self: seen in both roles first, then most conversations, most rows, first seen."""
    both = ((F.col("sender") > 0) & (F.col("recipient") > 0)).cast("int")
    return stats.agg(F.max_by("key", F.struct(both.alias("b"), "convs", "total", (-F.col("first_idx")).alias("f"), F.col("key").alias("k"))).alias("self_key"))


def widest_coverage(stats: DataFrame) -> DataFrame:
    """The key with most conversations; none where that is a tie."""
    best = stats.join(F.broadcast(stats.agg(F.max("convs").alias("convs"))), "convs", "left_semi")  # one row
    return best.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("self_key")).where("n = 1").select("self_key")


def names_to_urls(people: DataFrame) -> DataFrame:
    """The address first seen with each name."""
    return people.where((F.col("name_key") != "") & (F.col("url") != "")).groupBy("name_key").agg(F.min_by("url", "row_idx").alias("url"))


def threads(people: DataFrame) -> DataFrame:
    """Conversations folded by their set of correspondents: thread, conversations, messages, last time."""
    convs = people.groupBy("conv").agg(F.array_join(F.array_sort(F.collect_set("contact")), "|").alias("thread"), F.max("ts").alias("last_ts"), F.countDistinct("row_idx").alias("n"))
    return convs.groupBy("thread").agg(F.count(F.lit(1)).alias("conversations"), F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"))


def tail(rows: DataFrame, by: str, ts: str, seq: str, n: int = 5) -> DataFrame:
    """The last rows of each group, by time and place."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(ts), F.desc(seq))))
    return ranked.where(F.col("_r") <= n).drop("_r")


def row_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Counts of rows that differ by place, of differing cells, and of rows on one side only."""
    x = a.select(F.col(key).alias("_k"), F.struct(*columns).alias("a"))
    y = b.select(F.col(key).alias("_k"), F.struct(*columns).alias("b"))
    rows = x.join(y, "_k", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    cells = sum((F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) == F.lit(False)).cast("long") for c in columns)
    return rows.agg(
        F.count_if(both & (cells > 0)).alias("rows_differ"), F.coalesce(F.sum(F.when(both, cells)), F.lit(0)).alias("cells_differ"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b")
    )


def positional_diff(a: DataFrame, b: DataFrame, first: int = 3, place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, places) of two tables compared row by row, without a key: in the order of their files where place names a column of
    `ordinal.with_place`, which is not compared, else in that of their partitions.

    counts is one row: rows_differ and cells_differ of rows that both have, only_a and only_b. places has row, column, a and b
    (as text) of the first cells that differ. Columns are taken by place too; those that one table lacks differ where the other has a value.
    With place, long texts are compared by their SHA-256, and both tables are read again for the texts of places.
    """
    columns = lambda df: [c for c in df.columns if c != place]
    width = max(len(columns(a)), len(columns(b)))

    def texts(df: DataFrame) -> list[Column]:
        return [F.col(f"`{c}`").cast("string") for c in columns(df)] + [F.lit(None).cast("string")] * (width - len(columns(df)))

    def cells(df: DataFrame, name: str) -> DataFrame:
        if not place:
            return numbered(df.select(F.array(*texts(df)).alias(name)), "row")
        return in_file_order(df.select(F.array(*map(_brief, texts(df))).alias(name), F.col(place).alias(f"{name}_place"), place), place, "row")

    both = cells(a, "a").join(cells(b, "b"), "row", "full_outer")
    at = F.sequence(F.lit(0), F.lit(width - 1))
    unlike = F.filter(at, lambda k: ~F.get("a", k).eqNullSafe(F.get("b", k)))
    rows = stored(both.withColumn("unlike", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), unlike)).where("a is null or b is null or size(unlike) > 0"))
    counts = rows.agg(
        F.count_if(F.size("unlike") > 0).alias("rows_differ"), F.coalesce(F.sum(F.when(F.col("unlike").isNotNull(), F.size("unlike"))), F.lit(0)).alias("cells_differ"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b")
    )
    wide = rows.where("size(unlike) > 0").orderBy("row").limit(first)
    if place:  # whole texts of these few rows only
        for df, name in ((a, "a"), (b, "b")):
            there = df.select(F.array(*texts(df)).alias(name), F.col(place).alias(f"{name}_place"))
            wide = there.join(F.broadcast(wide.drop(name)), f"{name}_place")
    wide = wide.select("row", F.explode("unlike").alias("column"), "a", "b")
    return counts, wide.orderBy("row", "column").limit(first).select("row", "column", F.get("a", F.col("column")).alias("a"), F.get("b", F.col("column")).alias("b"))


def _brief(text: Column) -> Column:
    """Short texts as they are, longer ones as their SHA-256: what is compared, so that no long text is shuffled or stored."""
    return F.when(F.length(text) > 64, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(F.concat(F.lit("="), text))


def digest(rows: DataFrame) -> DataFrame:
    """Row count and an order-free digest of all rows: equal tables, equal digests, repeated rows counting each.

    A row's values as text, by column name, each after its length, which no null has; the digest is the sum of 60 bits of its MD5."""
    kinds = dict(rows.dtypes)
    text = lambda c: F.to_json(F.struct(F.col(f"`{c}`"))) if "<" in kinds[c] else F.col(f"`{c}`").cast("string")
    value = lambda t: F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-"))
    row = F.concat(F.lit(""), *[value(text(c)) for c in sorted(rows.columns)])
    part = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))
