"""Activity analytics: a month cube of posts and comments, and views over it.

An activity table has ts (time without zone), kind (`post` or `comment`), share_type (of posts)
and topics (array). The cube's tables are one row a month, month and topic, month, weekday and
hour, or day: views touch months, not events.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.constants import RANGE_MONTHS
from tracewell.functions.dates import day_key, js_round, month_key
from tracewell.functions.labels import month_label, range_key
from tracewell.operators.stored import stored

#: Ranges whose timeline goes by weeks.
WEEKLY_RANGES = ("1m", "3m")
SHARE_TYPES = ("textOnly", "links", "media")


@dataclass(frozen=True)
class Filters:
    """A view's filters; None or `all` means unfiltered. day is 0 for Monday."""

    time_range: str = "12m"
    topic: str = "all"
    month: str | None = None
    day: int | None = None
    hour: int | None = None
    share_type: str = "all"

    def toggle(self, **chosen) -> Filters:
        """The filters after a click: what is chosen is set, or cleared where it was set. A week chooses its month."""
        if "week" in chosen:
            chosen = {**{k: v for k, v in chosen.items() if k != "week"}, "month": chosen["week"][:7]}
        none = {"topic": "all", "share_type": "all"}
        same = all(getattr(self, k) == v for k, v in chosen.items())
        return Filters(**{**self.__dict__, **({k: none.get(k) for k in chosen} if same else chosen)})


    @classmethod
    def parse(cls, params: dict[str, object]) -> Filters:
        """Filters of a route's texts (range, topic, month, day, hour, shareType); what is no value of its filter is left unset."""
        text = lambda k: "" if params.get(k) is None else str(params[k]).strip()
        whole = lambda k, most: int(text(k)) if re.fullmatch(r"\d+", text(k), re.ASCII) and int(text(k)) <= most else None
        month = text("month") if re.fullmatch(r"\d{4}-\d{2}", text("month"), re.ASCII) else None
        return cls(range_key(params.get("range")), text("topic") or "all", month, whole("day", 6), whole("hour", 23), text("shareType") or "all")


def month_totals(activity: DataFrame) -> DataFrame:
    rows = activity.where(F.col("ts").isNotNull()).groupBy(month_key(F.col("ts")).alias("month"))
    return rows.agg(F.count_if(F.col("kind") == "post").alias("posts"), F.count_if(F.col("kind") == "comment").alias("comments"), F.count(F.lit(1)).alias("total"))


def month_topics(activity: DataFrame) -> DataFrame:
    rows = activity.where(F.col("ts").isNotNull()).select(month_key(F.col("ts")).alias("month"), F.explode(F.array_distinct("topics")).alias("topic"))
    return rows.groupBy("month", "topic").agg(F.count(F.lit(1)).alias("n"))


def month_hours(activity: DataFrame) -> DataFrame:
    rows = activity.where(F.col("ts").isNotNull())
    return rows.groupBy(month_key(F.col("ts")).alias("month"), F.weekday("ts").alias("dow"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def month_share_types(activity: DataFrame) -> DataFrame:
    rows = activity.where(F.col("ts").isNotNull() & (F.col("kind") == "post"))
    return rows.groupBy(month_key(F.col("ts")).alias("month"), "share_type").agg(F.count(F.lit(1)).alias("n"))


def day_totals(activity: DataFrame) -> DataFrame:
    rows = activity.where(F.col("ts").isNotNull()).groupBy(day_key(F.col("ts")).alias("day"))
    kinds = [F.count_if((F.col("kind") == "post") & (F.col("share_type") == s)).alias(f"n_{s}") for s in SHARE_TYPES]
    return rows.agg(F.count_if(F.col("kind") == "post").alias("posts"), F.count_if(F.col("kind") == "comment").alias("comments"), F.count(F.lit(1)).alias("total"), *kinds)


def totals(activity: DataFrame) -> DataFrame:
    """One row: posts, comments, both together, days with any, and the first and the last of these."""
    return activity.agg(
        F.count_if(F.col("kind") == "post").alias("posts"), F.count_if(F.col("kind") == "comment").alias("comments"), F.count(F.lit(1)).alias("total"),
        F.countDistinct(day_key(F.col("ts"))).alias("active_days"), day_key(F.min("ts")).alias("first_day"), day_key(F.max("ts")).alias("last_day"),
    )


def heatmap(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows by weekday (0 for Monday) and hour."""
    return rows.groupBy(F.weekday(ts).alias("dow"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def shares(mix: DataFrame) -> DataFrame:
    """A content mix (share_type, n) with each type's share of all; none where all are 0."""
    return mix.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy())))  # a row a share type


#: A cell of the cube: what an event counts for, by table.
_CELL = "struct<level:string,day:string,dow:int,hour:int,name:string>"


def cube_cells(activity: DataFrame) -> DataFrame:
    """All tables of the cube in one: a row a table (level) and key, from one scan of the events and one shuffle.

    An event is repeated for each cell that it counts for: its month, its day, its weekday and hour,
    its share type where it is a post, and each of its topics."""
    month, day = month_key(F.col("ts")), day_key(F.col("ts"))
    post, comment = F.col("kind") == "post", F.col("kind") == "comment"
    cell = lambda level, **at: F.struct(F.lit(level).alias("level"), *[at.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("day", "string"), ("dow", "int"), ("hour", "int"), ("name", "string"))])
    none = F.array().cast(f"array<{_CELL}>")
    cells = F.concat(
        F.array(cell("totals"), cell("days", day=day), cell("hours", dow=F.weekday("ts"), hour=F.hour("ts"))),
        F.when(post, F.array(cell("share_types", name=F.col("share_type")))).otherwise(none),
        F.coalesce(F.transform(F.array_distinct("topics"), lambda t: cell("topics", name=t)), none),
    )
    rows = activity.where(F.col("ts").isNotNull()).select("ts", month.alias("month"), post.alias("post"), comment.alias("comment"), "share_type", F.explode(cells).alias("cell"))
    kinds = [F.count_if(F.col("post") & (F.col("share_type") == s)).alias(f"n_{s}") for s in SHARE_TYPES]
    return rows.groupBy("month", "cell").agg(F.count_if("post").alias("posts"), F.count_if("comment").alias("comments"), F.count(F.lit(1)).alias("total"), *kinds, F.min("ts").alias("first"), F.max("ts").alias("last")).select("month", "cell.*", "posts", "comments", "total", *[f"n_{s}" for s in SHARE_TYPES], "first", "last")


def cube(activity: DataFrame, joins: DataFrame | None = None) -> dict[str, DataFrame]:
    """The stored cube by its tables, which views read instead of events. `facts` has totals and the first and last time;
    with joins (month, n), the new connections by month, `growth` says how they follow the posts, where there is activity."""
    cells = stored(cube_cells(activity))
    of = lambda level, *columns: cells.where(F.col("level") == level).select(*columns)
    n = F.col("total").alias("n")
    tables = {
        "totals": of("totals", "month", "posts", "comments", "total"),
        "topics": of("topics", "month", F.col("name").alias("topic"), n),
        "hours": of("hours", "month", "dow", "hour", n),
        "share_types": of("share_types", "month", F.col("name").alias("share_type"), n),
        "days": of("days", "day", "posts", "comments", "total", *[f"n_{s}" for s in SHARE_TYPES]),
        "facts": of("totals", "*").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("posts", "comments", "total")], F.min("first").alias("first"), F.max("last").alias("last")),
    }
    if joins is not None:
        tables["joins"] = joins
        tables["growth"] = growth(tables["totals"].select("month", F.col("posts").alias("n")), joins)
    return tables


def _first(month: str | Column) -> Column:
    c = F.col(month) if isinstance(month, str) else month
    return F.to_date(F.concat(c, F.lit("-01")))


def months_of(totals: DataFrame, time_range: str = "all", month: str | None = None) -> DataFrame:
    """Every month of the range: all from the earliest to the latest active one, or the last ones."""
    span = totals.agg(_first(F.min("month")).alias("a"), _first(F.max("month")).alias("b")).where("b is not null")
    if month:
        return span.select(F.lit(month).alias("month"))
    if time_range != "all" and time_range not in RANGE_MONTHS:  # an unknown range is an empty view
        span = span.where(F.lit(False))
    elif time_range != "all":
        span = span.withColumn("a", F.add_months("b", 1 - RANGE_MONTHS[time_range]))
    return span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))


def timeline(totals: DataFrame, time_range: str = "all") -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return months_of(totals, time_range).join(totals, "month", "left").select("month", zero("posts"), zero("comments"), zero("total"))


def filtered_months(tables: dict[str, DataFrame], f: Filters) -> DataFrame:
    """month, posts, comments, total and the ratios of topic and hour, of the range's months that are kept.

    Counts under filters are estimates from a month's shares, rounded at every step, in this order:
    topic, share type, weekday and hour."""
    rows = months_of(tables["totals"], f.time_range, f.month).join(tables["totals"], "month")
    rows = rows.withColumn("all_posts", F.col("posts")).withColumn("all_total", F.col("total")).withColumn("topic_ratio", F.lit(1.0)).withColumn("hour_ratio", F.lit(1.0))
    if f.topic != "all":
        hit = tables["topics"].where(F.col("topic") == f.topic).select("month", F.col("n").alias("_topic"))
        rows = rows.join(hit, "month").withColumn("topic_ratio", F.col("_topic") / F.col("all_total"))
        rows = rows.withColumn("posts", js_round(F.col("posts") * F.col("topic_ratio"))).withColumn("comments", js_round(F.col("comments") * F.col("topic_ratio"))).withColumn("total", F.col("_topic")).drop("_topic")
    if f.share_type != "all":
        hit = tables["share_types"].where(F.col("share_type") == f.share_type).select("month", F.col("n").alias("_type"))
        share = F.coalesce(F.try_divide(F.coalesce("_type", F.lit(0)), F.col("all_posts")), F.lit(0.0))
        rows = rows.join(hit, "month", "left").withColumn("posts", js_round(F.col("posts") * share)).withColumn("comments", F.lit(0).cast("long")).withColumn("total", F.col("posts")).drop("_type")
    if f.day is not None or f.hour is not None:
        at = F.lit(True)
        at = at & (F.col("dow") == f.day) if f.day is not None else at
        at = at & (F.col("hour") == f.hour) if f.hour is not None else at
        base = (F.col("dow") == f.day) if f.day is not None else F.lit(True)
        hit = tables["hours"].groupBy("month").agg(F.sum(F.when(at, F.col("n")).otherwise(0)).alias("_hit"), F.sum(F.when(base, F.col("n")).otherwise(0)).alias("_base"))
        rows = rows.join(hit, "month")
        if f.hour is not None:
            rows = rows.withColumn("hour_ratio", F.coalesce(F.try_divide("_hit", "_base"), F.lit(0.0)))
        share = F.col("_hit") / F.col("all_total")
        rows = rows.select("month", *[js_round(F.col(c) * share).alias(c) for c in ("posts", "comments", "total")], "topic_ratio", "hour_ratio")
    return rows.select("month", "posts", "comments", "total", "topic_ratio", "hour_ratio")


def view(tables: dict[str, DataFrame], f: Filters) -> dict[str, DataFrame]:
    """The components of a view. Kept months are those with a filtered total; the timeline has all of the range.
    Heatmap, topics, content mix and active days of the kept months are not scaled. timeline_max is the largest
    unfiltered month of the range; topics shift only where nothing but the range is filtered. Of WEEKLY_RANGES timeline,
    timeline_max and trend go by weeks. points are the timeline's key, label and value, whatever it goes by. The one-row
    components have a row a month or day to go over, whatever the number of events."""
    by_week = f.time_range in WEEKLY_RANGES
    months = filtered_months(tables, f).where("total <> 0")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    line = months_of(tables["totals"], f.time_range, f.month).join(months, "month", "left").select("month", zero("posts"), zero("comments"), zero("total"))
    kept = F.broadcast(months.select("month"))  # a row a month
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    heatmap = tables["hours"].join(kept, "month").groupBy("dow", "hour").agg(F.sum("n").alias("n"))
    days = tables["days"].join(kept, F.substring("day", 1, 7) == kept["month"]).select("day")
    plain = f.topic == "all" and f.share_type == "all" and f.day is None and f.hour is None
    shift = topic_shift(months, tables["topics"].join(kept, "month"))
    if by_week:
        line = week_line(tables, f)
        points, most = line.select(F.col("week").alias("key"), "label", "value"), week_line(tables, Filters(f.time_range, month=f.month)).select("value")
    else:
        points = line.select(F.col("month").alias("key"), month_label(F.col("month")).alias("label"), F.col("total").alias("value"))
        most = months_of(tables["totals"], f.time_range, f.month).join(tables["totals"], "month").select(F.col("total").alias("value"))
    return {
        "timeline": line,
        "points": points,
        "timeline_max": most.agg(F.greatest(F.lit(1), F.coalesce(F.max("value"), F.lit(1))).cast("long").alias("timeline_max")),
        "peaks": peak(heatmap, "hour", "peak_hour").crossJoin(peak(heatmap, "dow", "peak_day")),  # of one row each
        "streaks": streaks(days.select(F.to_date("day").alias("d")), []),
        "trend": trend(points.select(F.col("key").alias("month"), F.col("value").alias("total"))),
        "topic_shift": shift if plain else shift.where(F.lit(False)),
        "ratio_trend": ratio_trend(months),
        "totals": months.agg(whole("posts"), whole("comments")).withColumn("total", F.col("posts") + F.col("comments")),
        "heatmap": heatmap,
        "topics": top(tables["topics"].join(kept, "month").groupBy("topic").agg(F.sum("n").alias("n")), "n", ["topic"], 12),
        "content_mix": tables["share_types"].join(kept, "month").groupBy("share_type").agg(F.sum("n").alias("n")),
        "active_days": days,
    }


def peak(heatmap: DataFrame, key: str, name: str) -> DataFrame:
    """One row: the hour or weekday with most activity, the earlier of ties; 0 where there is none."""
    return heatmap.groupBy(key).agg(F.sum("n").alias("n")).agg(F.coalesce(F.max_by(key, F.struct("n", -F.col(key))), F.lit(0)).alias(name))


def top(rows: DataFrame, by: str, ties: list[str], n: int) -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(n)


def weekly(tables: dict[str, DataFrame], f: Filters) -> DataFrame:
    """Monday weeks over the range's months; days outside the months do not count, values are rounded by week."""
    span = months_of(tables["totals"], f.time_range, f.month).agg(_first(F.min("month")).alias("a"), F.last_day(_first(F.max("month"))).alias("b"))
    weeks = span.select(F.explode(F.expr("sequence(cast(date_trunc('week', a) as date), cast(date_trunc('week', b) as date), interval 7 days)")).alias("week"))
    value = F.col(f"n_{f.share_type}" if f.share_type != "all" else "total").cast("double")
    days = tables["days"].withColumn("d", F.to_date("day")).join(F.broadcast(span), F.col("d").between(F.col("a"), F.col("b")))
    if f.day is not None:
        value = F.when(F.weekday("d") == f.day, value).otherwise(0.0)
    if f.topic != "all" or f.hour is not None:
        ratios = filtered_months(tables, Filters(f.time_range, f.topic, f.month, f.day, f.hour)).select("month", "topic_ratio", "hour_ratio")
        days = days.join(ratios, F.substring("day", 1, 7) == ratios["month"], "left")
        value = value * F.coalesce("topic_ratio", F.lit(0.0)) * F.coalesce("hour_ratio", F.lit(0.0))
    sums = days.groupBy(F.date_trunc("week", "d").cast("date").alias("week")).agg(F.sum(value).alias("v"))
    return weeks.join(sums, "week", "left").select(F.date_format("week", "yyyy-MM-dd").alias("week"), js_round(F.coalesce("v", F.lit(0.0))).alias("value"))


def week_line(tables: dict[str, DataFrame], f: Filters) -> DataFrame:
    """week, month, label and value of each week of weekly(); a week belongs to the month of its Monday."""
    weeks = weekly(tables, f)
    return weeks.select("week", F.substring("week", 1, 7).alias("month"), F.date_format(F.to_date("week"), "MMM dd").alias("label"), "value")


def streaks(days: DataFrame, by: list[str]) -> DataFrame:
    """Longest run of days and the run that ends at the latest day, for distinct days (`d`) by keys."""
    rows = days.select(*by, "d").distinct()
    run = rows.withColumn("run", F.date_sub("d", F.row_number().over(W.partitionBy(*by).orderBy("d"))))
    runs = run.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return runs.groupBy(*by).agg(zero(F.max("n")).alias("longest"), zero(F.max_by("n", "last")).alias("current"))


def trend(line: DataFrame) -> DataFrame:
    """Older against recent half of a timeline (month, total): percent and direction."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    rows = line.withColumn("k", F.row_number().over(W.orderBy("month"))).withColumn("half", F.floor(n / 2)).withColumn("n", n)
    sums = rows.where("n >= 2").agg(F.sum(F.when(F.col("k") <= F.col("half"), F.col("total"))).alias("older"), F.sum(F.when(F.col("k") > F.col("half"), F.col("total"))).alias("recent")).where("older is not null")
    percent = F.when(F.col("older") == 0, F.when(F.col("recent") > 0, 100.0).otherwise(0.0)).otherwise((F.col("recent") - F.col("older")) / F.nullif(F.col("older"), F.lit(0)) * 100.0)
    rows = sums.withColumn("percent", percent)
    flat = F.when(F.col("percent") > 8, "up").when(F.col("percent") < -12, "down").otherwise("flat")
    return rows.select("older", "recent", "percent", F.when(F.col("older") == 0, F.when(F.col("recent") > 0, "up").otherwise("flat")).otherwise(flat).alias("direction"))


def ratio_trend(line: DataFrame) -> DataFrame:
    """Comments per post, first half against last half of a timeline of six months or more; the middle month is left out."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    rows = line.withColumn("k", F.row_number().over(W.orderBy("month"))).withColumn("half", F.floor(n / 2)).withColumn("n", n).where("n >= 6")
    first, last = F.col("k") <= F.col("half"), F.col("k") > F.col("n") - F.col("half")
    total = lambda w, c: F.sum(F.when(w, F.col(c)).otherwise(0))
    sums = rows.agg(F.try_divide(total(first, "comments"), total(first, "posts")).alias("prior"), F.try_divide(total(last, "comments"), total(last, "posts")).alias("recent"))
    rows = sums.where("prior > 0 and recent is not null").withColumn("change", F.col("recent") / F.col("prior"))
    return rows.select("prior", "recent", F.when(F.col("change") >= 1.5, "more-engaging").when(F.col("change") <= 0.6, "more-posting").alias("direction"))


def topic_shift(months: DataFrame, topics: DataFrame) -> DataFrame:
    """The most frequent topics of the first and last third of six months or more, where they differ; ties go to the lesser name."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    rows = months.select("month").withColumn("k", F.row_number().over(W.orderBy("month"))).withColumn("n", n).where("n >= 6").withColumn("third", F.floor(F.col("n") / 3))
    part = F.when(F.col("k") <= F.col("third"), "from").when(F.col("k") > F.col("n") - F.col("third"), "to")
    counts = topics.join(F.broadcast(rows.select("month", part.alias("part"))), "month").where("part is not null").groupBy("part", "topic").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy(F.desc("n"), "topic"))).where("r = 1")
    both = best.agg(F.max(F.when(F.col("part") == "from", F.col("topic"))).alias("from_topic"), F.max(F.when(F.col("part") == "to", F.col("topic"))).alias("to_topic"))
    return both.where("from_topic <> to_topic")


def growth(posts: DataFrame, joins: DataFrame) -> DataFrame:
    """How new connections follow posting, over the months that both series (month, n) span: correlation, averages of
    quiet months (at most two posts) and of the ten busiest, and their multiple."""
    span = posts.agg(F.min("month").alias("a1"), F.max("month").alias("b1")).crossJoin(joins.agg(F.min("month").alias("a2"), F.max("month").alias("b2")))
    span = span.select(_first(F.greatest("a1", "a2")).alias("a"), _first(F.least("b1", "b2")).alias("b")).where("a <= b")
    months = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    rows = months.join(posts.select("month", F.col("n").alias("p")), "month", "left").join(joins.select("month", F.col("n").alias("c")), "month", "left")
    rows = rows.select("month", F.coalesce("p", F.lit(0)).cast("double").alias("p"), F.coalesce("c", F.lit(0)).cast("double").alias("c"))
    rows = rows.withColumn("busy", F.row_number().over(W.orderBy(F.desc("p"), "month")))
    facts = rows.agg(
        F.count(F.lit(1)).alias("months"),
        F.covar_pop("p", "c").alias("cov"),
        (F.var_pop("p") * F.var_pop("c")).alias("var"),
        js_round(F.coalesce(F.avg(F.when(F.col("p") <= 2, F.col("c"))), F.lit(0.0))).alias("quiet_avg"),
        js_round(F.coalesce(F.avg(F.when(F.col("busy") <= 10, F.col("c"))), F.lit(0.0))).alias("top_avg"),
    )
    facts = facts.withColumn("corr", F.try_divide(F.col("cov"), F.nullif(F.sqrt("var"), F.lit(0.0))))
    multiple = F.coalesce(js_round(F.try_divide("top_avg", "quiet_avg")), F.lit(0))
    return facts.withColumn("multiplier", multiple).select("months", (js_round(F.col("corr") * 100) / 100).alias("corr"), "quiet_avg", "top_avg", "multiplier", ((F.col("months") >= 12) & (F.coalesce("corr", F.lit(0.0)) > 0) & (F.col("multiplier") >= 2)).alias("shown"))
