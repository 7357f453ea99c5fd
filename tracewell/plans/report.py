"""The tables of a report: stat tiles, captions, tips, lists and chart series by section. Nothing is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import labels as L
from tracewell.functions.constants import BLANK_STATS, NO_CONNECTIONS_TIP, POST_TIP, SILENT_TIP, TOP_AND_FADING_TIP, TOP_TIP, WEEKDAYS
from tracewell.functions.dates import network_age
from tracewell.operators import messages as M
from tracewell.operators import people as P
from tracewell.plans.insights import with_texts


def tiles(facts: DataFrame, *stats: tuple[str, Column]) -> DataFrame:
    """position, label and value of the stats of one row of facts, in order; those that are null are left out."""
    cells = F.array(*[F.struct(F.lit(label).alias("label"), value.cast("string").alias("value")) for label, value in stats])
    rows = facts.select(F.posexplode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("position", "s"))
    return rows.select(F.col("position").cast("long").alias("position"), "s.label", "s.value")


def measured(stats: DataFrame) -> DataFrame:
    """The tiles that measured anything."""
    return stats.where(~F.trim("value").isin(*BLANK_STATS))


def has_data(chart: DataFrame, cell: str | None = None) -> bool:
    """Whether a series has a row, or a grid of cells one above 0."""
    return not (chart.where(F.col(cell) > 0) if cell else chart).isEmpty()


def exportable(insights: DataFrame | None = None, growth: DataFrame | None = None, outreach: DataFrame | None = None, *files: DataFrame) -> bool:
    """Whether a report would hold anything: cards, growth that is shown, an outreach row, or a row of activity, messages or connections."""
    shown = growth.where("shown") if growth is not None else None
    return any(d is not None and not d.isEmpty() for d in (insights, shown, outreach, *files))


def caption(months: DataFrame, fallback: str = "") -> DataFrame:
    """One row: the first to the last month of a timeline (month), or the fallback where it has none."""
    text = L.window_caption(F.min("month"), F.max("month"))
    return months.agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback)).alias("caption"))


def activity_tiles(view: dict[str, DataFrame]) -> DataFrame:
    """The tiles of a view; no rows without activity."""
    facts = view["totals"].where("total > 0").crossJoin(view["peaks"]).crossJoin(view["streaks"])  # of one row each
    return tiles(
        facts, ("Posts", F.col("posts")), ("Comments", F.col("comments")), ("Total activity", F.col("total")),
        ("Peak hour", F.format_string("%02d:00", "peak_hour")), ("Current streak", F.concat(F.col("current").cast("string"), F.lit(" days"))),
    )


def all_time_tiles(growth: DataFrame, outreach: DataFrame) -> DataFrame:
    """The tiles of network growth, where it is shown, and of outreach, from rows of `growth` and `outreach_of`."""
    facts = outreach.join(growth.where("shown").select("multiplier"), F.lit(True), "left")  # of a row each
    return tiles(
        facts, ("Network growth", F.concat(F.col("multiplier").cast("string"), F.lit("×"))), ("Outreach initiated", F.col("self_initiated")),
        ("Reply rate", L.reply_rate(F.col("reply_rate"))), ("Unanswered", F.col("unanswered_contacts")), ("Sent : received", L.sent_ratio(F.col("sent_received_ratio"))),
    )


def connections_view(connections: DataFrame, now: str, key: str = "12m") -> dict[str, DataFrame]:
    """Of connections (row_idx, ts, company, position): companies, positions and stats of a range; growth and age of all time."""
    rows = P.in_range(connections, "ts", key, now)
    best = P.mode(rows, "company").select(F.col("value").alias("top_company"))
    stats = P.connection_stats(connections, "ts", now).crossJoin(rows.agg(F.count(F.lit(1)).alias("recent")))  # of one row each
    return {
        "timeline": P.month_counts(connections, "ts"),
        "companies": P.top_values(rows, "company"),
        "positions": P.top_values(rows, "position"),
        "stats": stats.join(best, F.lit(True), "left").select("total", "recent", F.coalesce("top_company", F.lit("-")).alias("top_company"), network_age(F.col("age_months")).alias("network_age")),
    }


def connection_tiles(view: dict[str, DataFrame]) -> DataFrame:
    return tiles(view["stats"], ("Total connections", F.col("total")), ("Top company", F.col("top_company")), ("Network age", F.col("network_age")))


def message_tiles(events: DataFrame, connections: DataFrame, fading: DataFrame, key: str = "12m") -> DataFrame:
    one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    facts = M.range_totals(events, key).crossJoin(one(connections, "connections")).crossJoin(one(fading, "fading"))  # of one row each
    return tiles(facts, ("Messages in range", F.col("messages")), ("People in range", F.col("people")), ("Total connections", F.col("connections")), ("Fading conversations", F.col("fading")))


#: What a dashboard of the report model is; its charts hold points (line), items (bar), a grid of seven days (heatmap) or entries (list).
_POINT = "struct<label:string,value:bigint>"
_ENTRY = "struct<primary:string,secondary:string,value:string>"
_CHART = f"struct<type:string,title:string,points:array<{_POINT}>,items:array<{_POINT}>,grid:array<array<bigint>>,entries:array<{_ENTRY}>>"


def _listed(rows: DataFrame, value: Column, name: str, *order: Column) -> DataFrame:
    """One row: the values of a short list in their order, as an array; empty where it has no rows."""
    by = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], value.alias("_v"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(by)), lambda x: x["_v"]).alias(name))


def _chart(kind: str, title: Column, **parts: Column) -> Column:
    types = {"points": f"array<{_POINT}>", "items": f"array<{_POINT}>", "grid": "array<array<bigint>>", "entries": f"array<{_ENTRY}>"}
    return F.struct(F.lit(kind).alias("type"), title.alias("title"), *[parts.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def _dashboard(title: str, subtitle: Column, stats: str, *charts: Column) -> Column:
    return F.struct(F.lit(title).alias("title"), subtitle.alias("subtitle"), F.col(stats).alias("stats"), F.array(*charts).alias("charts"))


def _stats(stats: DataFrame, name: str) -> DataFrame:
    return _listed(stats, F.struct("label", "value"), name, F.col("position"))


def _together(*frames: DataFrame) -> DataFrame:
    """One row of frames of one row each."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


def _grid(heatmap: DataFrame) -> DataFrame:
    """One row: a heatmap (dow, hour, n) as seven days of 24 hours."""
    cells = heatmap.agg(F.map_from_entries(F.collect_list(F.struct(F.col("dow") * 24 + F.col("hour"), F.col("n")))).alias("m"))  # at most 168
    hours = lambda d: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.element_at("m", d * 24 + h), F.lit(0)).cast("long"))
    return cells.select(F.transform(F.sequence(F.lit(0), F.lit(6)), hours).alias("grid"))


def activity_dashboard(view: dict[str, DataFrame], subtitle: DataFrame) -> DataFrame:
    """One row, activity: the dashboard of a view, null without activity. subtitle is a row of `caption`."""
    item = F.struct(F.col("topic").alias("label"), F.col("n").alias("value"))
    facts = _together(
        _stats(activity_tiles(view), "s"), _listed(view["points"], F.struct("label", "value"), "p", F.col("key")), _listed(view["topics"], item, "i", -F.col("n"), F.col("topic")), _grid(view["heatmap"]), subtitle
    )
    made = _dashboard("Analytics", F.col("caption"), "s", _chart("line", F.lit("Activity timeline"), points=F.col("p")), _chart("bar", F.lit("Top topics"), items=F.col("i")), _chart("heatmap", F.lit("When you are active"), grid=F.col("grid")))
    return facts.select(F.when(F.size("s") > 0, made).alias("activity"))


def connections_dashboard(view: dict[str, DataFrame]) -> DataFrame:
    """One row, connections: the dashboard of connections of all time, null without any. view is of the range `all`."""
    item = F.struct(F.col("value").alias("label"), F.col("n").alias("value"))
    listed = lambda k: _listed(view[k], item, k, -F.col("n"), F.col("first_idx"))
    line = _listed(view["timeline"], F.struct(L.month_label(F.col("month")).alias("label"), F.col("n").alias("value")), "p", F.col("month"))
    facts = _together(_stats(connection_tiles(view), "s"), line, listed("companies"), listed("positions"), view["stats"].select("total"))
    made = _dashboard("Connections", F.lit(L.range_label("all")), "s", _chart("line", F.lit("Connection growth"), points=F.col("p")), _chart("bar", F.lit("Top companies"), items=F.col("companies")), _chart("bar", F.lit("Top positions"), items=F.col("positions")))
    return facts.select(F.when(F.col("total") > 0, made).alias("connections"))


def messages_dashboard(messages: DataFrame, events: DataFrame, connections: DataFrame, fading: DataFrame, panels: dict[str, DataFrame] | None = None, key: str = "12m") -> DataFrame:
    """One row, messages and window (its caption): the dashboard of dated messages (row_idx, ts), null without any.

    panels, where people are to be named, has the top, silent and fading lists with the columns of their sheets."""
    months = M.monthly(messages, key)
    line = _listed(months, F.struct(L.month_label(F.col("month")).alias("label"), F.col("n").alias("value")), "p", F.col("month"))
    frames = [_stats(message_tiles(events, connections, fading, key), "s"), line, caption(months, L.range_label(key).lower()), messages.agg(F.count(F.lit(1)).alias("_n"))]
    charts = [_chart("line", F.lit("Messages per month"), points=F.col("p"))]
    day = lambda c: F.date_format(c, "MMM d, yyyy")
    said = F.concat(F.lit("Last message: "), day(F.col("Last Message")))
    role = F.coalesce(F.nullif(F.concat_ws(" @ ", F.nullif(F.col("Position"), F.lit("")), F.nullif(F.col("Company"), F.lit(""))), F.lit("")), F.lit("No role info"))
    shown = {
        "top": ("Top contacts", said, F.concat(F.col("Messages").cast("string"), F.lit(" msgs")), [-F.col("Messages"), -F.unix_seconds(F.col("Last Message").cast("timestamp")), F.col("Name")]),
        "silent": ("Silent connections", role, F.coalesce(day(F.col("Connected On")), F.lit("No date")), [F.col("Connected On").isNull(), F.col("Connected On"), F.col("Name"), F.col("URL")]),
        "fading": ("Fading conversations", said, F.concat(F.col("Days Since").cast("string"), F.lit(" days")), [-F.unix_seconds(F.col("Last Message").cast("timestamp")), F.col("Name")]),
    }
    for name, (label, second, value, order) in shown.items() if panels else ():
        rows = panels[name]
        entry = F.struct(F.col("Name").alias("primary"), second.alias("secondary"), value.alias("value"))
        first = rows.orderBy(*order).limit(L.LIST_LIMIT)
        frames += [_listed(first, entry, name, *order), rows.agg(L.list_title(label, F.count(F.lit(1))).alias(f"{name}_title"))]
        charts.append(_chart("list", F.col(f"{name}_title"), entries=F.col(name)))
    subtitle = F.concat(F.lit("Messages and people: "), F.col("caption"), F.lit(". Connections, silent and fading: all time."))
    facts = _together(*frames)
    return facts.select(F.when(F.col("_n") > 0, _dashboard("Messages", subtitle, "s", *charts)).alias("messages"), F.when(F.col("_n") > 0, F.col("caption")).alias("window"))


def report_model(activity: DataFrame, connections: DataFrame, messages: DataFrame, windows: DataFrame, cards: DataFrame, tip: DataFrame, all_time: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """One row, the whole report: range_label, dashboards (those with something to show, in their order), insights, tip, all_time and threads.

    cards are those of `tracewell.plans.insights`, here with their texts. windows is the caption of the activity months; the messages' window stands in where that is empty. threads has
    `tracewell.operators.threads.recent_threads`'s columns. `as_json` writes the row as a document."""
    stat = "struct<label:string,value:string>"
    parts = [activity, connections, messages, windows, _listed(with_texts(cards), F.struct("id", "title", "body", "icon", "accent"), "insights", F.col("position")), tip.agg(F.max("tip").alias("tip")), _stats(all_time, "all_time")]
    if threads is not None:
        entry = F.struct("ts", "direction", "body")
        one = threads.groupBy("thread", "name", "message_count", "last_ts").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", entry.alias("e")))).alias("e"))  # a thread's few last messages
        one = one.select("last_ts", "thread", F.struct("name", "message_count", F.transform("e", lambda x: x["e"]).alias("entries")).alias("t"))
        parts.append(_listed(one, F.col("t"), "threads", -F.unix_micros(F.col("last_ts").cast("timestamp")), F.col("thread")))
    facts = _together(*parts)
    boards = F.filter(F.array("activity", "connections", "messages"), lambda d: d.isNotNull())
    label = F.coalesce(F.nullif("caption", F.lit("")), F.col("window"), F.lit(""))
    return facts.select(label.alias("range_label"), boards.alias("dashboards"), "insights", "tip", F.col("all_time").cast(f"array<{stat}>").alias("all_time"), *(["threads"] if threads is not None else []))


def as_json(model: DataFrame) -> DataFrame:
    """A model's row as one text, blanks kept."""
    return model.select(F.to_json(F.struct(*model.columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("document"))


def titles(lists: dict[str, DataFrame]) -> DataFrame:
    """label and title of each list, with its whole length where it is cut."""
    rows = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("label"), L.list_title(k, F.col("n")).alias("title")) for k, d in lists.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def post_tip(facts: DataFrame) -> DataFrame:
    """The tip of the insights: when to post; none without activity."""
    day = F.get(F.array(*map(F.lit, WEEKDAYS)), F.col("peak_day"))
    return facts.where("total > 0").select(F.format_string(POST_TIP, day, F.col("peak_hour")).alias("tip"))


def message_tip(top: DataFrame, silent: DataFrame, fading: DataFrame, connections: bool = True) -> DataFrame:
    """One row, the tip of the message screen, null where there is nothing to say. Without a file of connections it asks for one.

    top has name, n and last_ts, fading name, days_since and last_ts; the first of each in its list's order counts."""
    if not connections:
        return silent.agg(F.lit(NO_CONNECTIONS_TIP).alias("tip"))
    first = top.orderBy(F.desc("n"), F.desc("last_ts"), "name").limit(1).select(F.col("name").alias("_top"))
    faded = fading.orderBy(F.desc("last_ts"), "name").limit(1).select(F.col("name").alias("_fading"), "days_since")
    facts = silent.agg(F.count(F.lit(1)).alias("_n")).join(first, F.lit(True), "left").join(faded, F.lit(True), "left")  # of a row each
    people = F.when(F.col("_n") == 1, "connection").otherwise("connections")
    tip = F.when(F.col("_top").isNotNull() & F.col("_fading").isNotNull(), F.format_string(TOP_AND_FADING_TIP, "_top", "_fading", "days_since")).when(F.col("_top").isNotNull(), F.format_string(TOP_TIP, "_top"))
    return facts.select(tip.when(F.col("_n") > 0, F.format_string(SILENT_TIP, F.col("_n"), people)).alias("tip"))
