"""From cleaned message and connection exports to contacts, relationship panels and recent threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import dates as D
from tracewell.functions import text as X
from tracewell.operators import messages as M
from tracewell.operators import people as P
from tracewell.operators import threads as T
from tracewell.operators.stored import stored
from tracewell.sources.specs import MESSAGES

PANELS = ("top", "silent", "fading")


def exported(rows: DataFrame) -> DataFrame:
    """Raw rows of a messages export as a report takes them: cells cleaned but for CONTENT, which stays as it was written, and no
    cell made safe for a sheet; rows that lack what a message must have are left out, as in the cleaned file."""
    cells = [(F.coalesce(F.col(f"`{c.name}`"), F.lit("")) if c.name == "CONTENT" else c.cleaner(F.col(f"`{c.name}`"))).alias(c.name) for c in MESSAGES.columns]
    extra = [c for c in rows.columns if c not in MESSAGES.names]
    out = rows.select(*[f"`{c}`" for c in extra], *cells)
    for name in MESSAGES.row_required:
        out = out.where(~X.is_missing(F.col(f"`{name}`")))
    return out


def messages_of(rows: DataFrame) -> DataFrame:
    """Dated messages of a messages export, as `tracewell.operators.threads` takes them; rows may be cleaned or raw."""
    urls = X.url_keys(F.col("RECIPIENT PROFILE URLS"))
    several = X.several_recipients(F.col("RECIPIENT PROFILE URLS")) | X.several_recipients(F.col("TO"))
    out = rows.select(
        "row_idx", X.trim(F.col("CONVERSATION ID")).alias("conv"), D.parse_either(F.regexp_replace(X.trim(F.col("DATE")), r"(?i) UTC\z", "")).alias("ts"), X.trim(F.col("FROM")).alias("sender"), X.url_key(F.col("SENDER PROFILE URL")).alias("sender_url"),
        X.recipient_names(F.col("TO"), F.col("RECIPIENT PROFILE URLS")).alias("names"), urls.alias("urls"), several.alias("several"), F.col("CONTENT").alias("body"),
    )
    return out.where("ts is not null")


def connections_of(rows: DataFrame) -> DataFrame:
    """row_idx, name, name_key, url, ts (null where undated), company and position of connections with a name or an address."""
    full = X.trim(F.concat_ws(" ", X.trim(F.col("First Name")), X.trim(F.col("Last Name"))))
    url = X.url_key(F.col("URL"))
    out = rows.select("row_idx", F.coalesce(F.nullif(full, F.lit("")), url).alias("name"), X.name_key(full).alias("name_key"), url.alias("url"), D.parse_day(F.col("Connected On")).alias("ts"), F.col("Company").alias("company"), F.col("Position").alias("position"))
    return out.where((F.col("name") != "") | (F.col("url") != ""))


def contact_keys(connections: DataFrame) -> DataFrame:
    """Names and addresses of connections, each once."""
    return connections.select(F.explode(F.array("name_key", "url")).alias("contact_key")).where("contact_key <> ''").distinct()


def people_of(messages: DataFrame) -> DataFrame:
    """A row a message and person with a name or an address, mine where it is the account's owner; ties about the owner go to who is seen first."""
    people = P.participants(messages, F.col("sender"), F.col("sender_url"), F.col("names"), F.col("urls")).withColumn("name_key", X.name_key(F.col("name")))
    people = stored(people.select("row_idx", F.when(F.col("conv") != "", F.col("conv")).otherwise(F.concat(F.lit("row-"), F.col("row_idx").cast("string"))).alias("conv"), "ts", "role", "name", "name_key", "url"))
    self = P.pick_self(P.self_stats(people, "url")).select(F.col("self_key").alias("_url")).crossJoin(P.pick_self(P.self_stats(people, "name_key")).select(F.col("self_key").alias("_name")))
    mine = F.coalesce(F.col("url") == F.col("_url"), F.lit(False)) | F.coalesce(F.col("name_key") == F.col("_name"), F.lit(False))
    return people.crossJoin(F.broadcast(self)).withColumn("mine", mine).drop("_url", "_name")


def events_of(messages: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """A row a message and person other than the account's owner, with contact; people is that of `people_of`, where it is at hand."""
    people = people_of(messages) if people is None else people
    return P.canonical_contacts(people.where("not mine").drop("mine"))


def outreach_of(messages: DataFrame, people: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """One row, the outreach funnel of dated messages. A sender without a name of their own neither replies nor counts as received.

    people and events, where they are at hand, are those of `people_of` and `events_of`, stored."""
    people = stored(people_of(messages)) if people is None else people
    events = P.canonical_contacts(people.where("not mine").drop("mine")) if events is None else events
    conv = F.when(F.col("conv") != "", F.col("conv")).otherwise(F.concat(F.lit("row-"), F.col("row_idx").cast("string")))
    senders = people.where("role = 'from'").select("row_idx", F.col("mine").alias("is_self"))
    rows = messages.select("row_idx", conv.alias("conv"), "ts").join(senders, "row_idx", "left")
    sides = events.select("row_idx", "contact", "role").join(senders, "row_idx", "left")
    written = sides.where("is_self or role = 'from'").select("contact", (F.col("role") == "to").alias("is_self"))
    return P.outreach(rows).crossJoin(M.unanswered(written))  # of one row each


def message_facts(rows: DataFrame) -> DataFrame:
    """One row: what `messages.skipped` counts of a messages export, undated rows included."""
    dated = messages_of(rows)
    all_rows = rows.select("row_idx").join(dated.select("row_idx", "ts"), "row_idx", "left")
    return M.skipped(all_rows, people_of(dated).where("not mine"))


def message_state(rows: DataFrame) -> dict[str, DataFrame]:
    """All that a messages export says, from one stored table of mentions: a row a dated message and person.

    events: mentions of others with their contact. contacts: their messages, last time, name and address. owner: the
    account's address and name. names: addresses first seen with a name. talked: addresses and names of others.
    skipped, months, unanswered, outreach: as of `message_facts`, `messages.monthly` and `outreach_of`. facts is one
    row: messages, first and last time, people, mentions.
    """
    dated = stored(messages_of(rows))
    people = stored(people_of(dated))
    events = stored(P.canonical_contacts(people.where("not mine").drop("mine")))
    conv = F.when(F.col("conv") != "", F.col("conv")).otherwise(F.concat(F.lit("row-"), F.col("row_idx").cast("string")))
    senders = people.where("role = 'from'").select("row_idx", F.col("mine").alias("is_self"))
    sides = events.select("row_idx", "contact", "role").join(senders, "row_idx", "left").where("is_self or role = 'from'")
    written = sides.select("contact", (F.col("role") == "to").alias("is_self"))
    times = dated.agg(F.count(F.lit(1)).alias("messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return {
        "messages": dated,
        "events": events,
        "contacts": P.contacts(events),
        "owner": people.where("mine").agg(F.max(F.nullif("url", F.lit(""))).alias("url"), F.max(F.nullif("name_key", F.lit(""))).alias("name_key")),
        "names": P.names_to_urls(people),
        "talked": events.select(F.explode(F.array("url", "name_key")).alias("contact_key")).where("contact_key <> ''").distinct(),
        "skipped": M.skipped(rows.select("row_idx").join(dated.select("row_idx", "ts"), "row_idx", "left"), people.where("not mine")),
        "months": M.monthly(dated),
        "unanswered": M.unanswered(written),
        "outreach": P.outreach(dated.select("row_idx", conv.alias("conv"), "ts").join(senders, "row_idx", "left")).crossJoin(M.unanswered(written)),  # of one row each
        "facts": times.crossJoin(events.agg(F.countDistinct("contact").alias("people"), F.count(F.lit(1)).alias("mentions"))),
    }


def panels(messages: DataFrame, connections: DataFrame, now: str, key: str = "12m", n: int = 10, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """The top, silent and fading lists in their own order, with the column names of their sheets; events is that of `events_of`, where it is stored."""
    events = stored(events_of(messages)) if events is None else events
    who = P.contacts(events).withColumn("url", F.when(F.col("contact").startswith("url:"), F.substring(F.col("contact"), 5, 1 << 20)).otherwise(""))
    top = P.top_contacts(events, key, n).join(who.select("contact", "name", "url"), "contact").orderBy(F.desc("n"), F.desc("last_ts"), "name")
    quiet = P.silent(connections, events.where("url <> ''").select("url").distinct(), events.where("name_key <> ''").select("name_key").distinct())
    matched = P.match_connections(who.withColumn("name_key", X.name_key(F.col("name"))), connections)
    fading = P.fading(matched, now).join(connections.select(F.col("row_idx").alias("connection"), "company"), "connection")
    return {
        "top": top.select(F.col("name").alias("Name"), F.col("url").alias("URL"), F.col("n").alias("Messages"), F.col("last_ts").alias("Last Message")),
        "silent": quiet.orderBy(F.asc_nulls_last("ts"), "name").select(F.col("name").alias("Name"), F.col("url").alias("URL"), F.col("ts").alias("Connected On"), F.col("position").alias("Position"), F.col("company").alias("Company")),
        "fading": fading.orderBy(F.desc("last_ts"), "name").select(F.col("name").alias("Name"), F.col("url").alias("URL"), F.col("days_since").alias("Days Since"), F.col("last_ts").alias("Last Message"), F.col("company").alias("Company")),
    }


def recent(messages: DataFrame, connections: DataFrame, people: int = 10, each: int = 5) -> DataFrame:
    """The most recent threads, owner and aliases told with the help of the connections."""
    return T.recent_threads(messages, contact_keys(connections), people, each)
