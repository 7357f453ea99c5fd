"""Recent message threads by who takes part in them, for a report.

A messages table has row_idx (place in the file), conv (blank where the file has none), ts, sender,
sender_url, names and urls of recipients (arrays, zipped by place), several (whether the raw row
names more than one recipient) and body. Rows without a time are left out by the caller.

Messages of a conversation that name the same people are first counted as one kind. Kinds become
mentions, one row a person and kind; everything else is grouping and joining of mentions by conversation, contact or
thread. Only the last messages of the chosen threads are read again. Where the account's owner cannot be told, directions are
`unknown` and the owner counts as a correspondent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.functions.constants import ANONYMOUS
from tracewell.operators.people import names_to_urls, own_key, tail, widest_coverage
from tracewell.operators.stored import small, stored

UNKNOWN = "Unknown"


def kinds(messages: DataFrame) -> DataFrame:
    """Messages of a conversation that are alike but for time and body as one: their number n, first row_idx and last ts.

    Messages without a conversation stay apart. The first row's place tells a kind."""
    lone = F.when(F.col("conv") != "", F.lit(None)).otherwise(F.col("row_idx"))
    rows = messages.groupBy("conv", "sender", "sender_url", "names", "urls", "several", lone.alias("_lone"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("row_idx"), F.max("ts").alias("ts")).drop("_lone")


def mentions(messages: DataFrame) -> DataFrame:
    """row_idx, conv, scope, ts, pos, role, name, name_key, url and anonymous of every person a message names.

    scope is the conversation, or the row where there is none; people without a name are kept only where
    a conversation gives them one to be anonymous in.
    """
    names, urls = F.col("names"), F.col("urls")
    name_at = lambda i: F.coalesce(F.nullif(F.get(names, i), F.lit("")), F.get(names, F.lit(0)), F.lit(""))
    person = lambda role, name, url: F.struct(F.lit(role).alias("role"), X.trim(name).alias("name"), url.alias("url"))
    to = F.when(F.size(urls) > 0, F.transform(urls, lambda u, i: person("to", name_at(i), u))).otherwise(F.transform(names, lambda n: person("to", n, F.lit(""))))
    rows = messages.select("row_idx", "conv", F.when(F.col("conv") != "", F.col("conv")).otherwise(F.concat(F.lit("row-"), F.col("row_idx").cast("string"))).alias("scope"), "ts", F.posexplode(F.concat(F.array(person("from", F.col("sender"), F.col("sender_url"))), to)).alias("pos", "p"))
    rows = rows.select("row_idx", "conv", "scope", "ts", "pos", "p.*").withColumn("anonymous", X.name_key(F.col("name")) == ANONYMOUS)
    rows = rows.where(((F.col("name") != "") | (F.col("url") != "")) & (~F.col("anonymous") | (F.col("conv") != "")))
    return rows.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit(UNKNOWN))).withColumn("name_key", F.when(F.col("name") == UNKNOWN, "").otherwise(X.name_key(F.col("name"))))


def with_contacts(people: DataFrame, known: DataFrame) -> DataFrame:
    """people with contact: by address, by conversation where anonymous, by the address known for the name, or by name."""
    direct = (F.col("url") != "") | F.col("anonymous")  # no name is looked up for these
    by_name = F.coalesce(F.concat(F.lit("url:"), "_known"), X.contact_key(F.lit(""), F.col("name_key")))
    named = people.where(~direct).withColumn("_own", own_key("name_key")).join(known.select(F.col("name_key").alias("_own"), F.col("url").alias("_known")), "_own", "left").withColumn("contact", by_name)
    rest = people.where(direct).withColumn("contact", F.when(F.col("url") != "", F.concat(F.lit("url:"), "url")).otherwise(F.concat(F.lit("anon:"), "scope")))
    return rest.unionByName(named.drop("_own", "_known"))


def identities(people: DataFrame) -> DataFrame:
    """key, convs, urls and names of every contact with an identity of its own."""
    rows = people.where(~F.col("anonymous")).withColumnRenamed("contact", "key")
    convs = rows.select("key", "scope").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("convs"))
    real = lambda c: F.collect_set(F.nullif(c, F.lit("")))
    spelled = rows.select("key", "url", "name_key").distinct().groupBy("key").agg(real("url").alias("urls"), real("name_key").alias("names"))
    return convs.join(spelled, "key")


def owner(index: DataFrame, contact_keys: DataFrame) -> DataFrame:
    """One row, urls and names of the account's owner; both empty where a tie leaves it open.

    Identities that are no known contacts come first, if that narrows the choice: an address is the
    evidence where there is one, else a name. Of those the one in most conversations is the owner.
    """
    evidence = index.select("key", F.explode(F.when(F.size("urls") > 0, F.col("urls")).otherwise(F.col("names"))).alias("contact_key"))
    known = evidence.join(contact_keys, "contact_key", "left_semi").select("key").distinct().withColumn("_known", F.lit(True))
    marked = index.join(known, "key", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    strangers = marked.agg((F.count_if(~F.col("_known")) > 0).alias("_any"))
    pool = marked.crossJoin(F.broadcast(strangers)).where(~F.col("_any") | ~F.col("_known"))
    best = index.join(F.broadcast(widest_coverage(pool).select(F.col("self_key").alias("key"))), "key")
    none = F.array().cast("array<string>")
    return best.agg(F.coalesce(F.first("urls"), none).alias("self_urls"), F.coalesce(F.first("names"), none).alias("self_names"))


def _is_self():
    return F.array_contains("self_urls", F.col("url")) | F.array_contains("self_names", F.col("name_key"))


def aliases(people: DataFrame, messages: DataFrame, known: DataFrame) -> DataFrame:
    """name_key and url for names that are only seen without an address, in a conversation of two people with one address.

    people are mentions without the owner and the anonymous; the first such conversation of a name counts.
    """
    own = X.contact_key(F.col("url"), F.col("name_key"))
    each = people.where("conv <> ''").groupBy("conv", "row_idx").agg(F.countDistinct(own).alias("_n"))
    groups = each.where("_n > 1").select("conv").union(messages.where("several and conv <> ''").select("conv")).distinct()
    pairs = people.where("conv <> ''").join(groups, "conv", "left_anti")
    one = pairs.where("url <> ''").groupBy("conv").agg(F.min("url").alias("_a"), F.max("url").alias("_b")).where("_a = _b").select("conv", F.col("_a").alias("_url"))
    lent = pairs.where("url = '' and name_key <> ''").join(one, "conv").groupBy("name_key").agg(F.min_by("_url", "row_idx").alias("url"))
    return lent.join(known, "name_key", "left_anti")


#: Threads that the budget looks at in one go.
FOLD = 4096


def _fold(rows: list, seen: dict[str, int], taken: list, people: int) -> None:
    """Take the threads in order while the people they add fit; seen says which of the taken ones added a person."""
    for r in rows:
        new = [m for m in dict.fromkeys(r.members) if m not in seen]
        if new and len(seen) + len(new) <= people:
            seen.update((m, len(taken)) for m in new)
            taken.append(r)
        if len(seen) >= people:
            return


def within_budget(threads: DataFrame, people: int = 10, block: int = FOLD) -> DataFrame:
    """thread and members (their number) of the threads taken, newest first, while the people they add fit the budget.

    A thread that does not fit is passed over, for good: people seen later leave as much less room as they leave
    it fewer to add. So only threads that add somebody and fit matter, and of equal sets of members the first. The next
    `block` of them, a sort that every partition cuts to that many, are folded in order; what they add leaves few or
    none, and a round more is made only where some are left, at most one a person of the budget. The others are taken
    where all their members were seen before them. Equal times are ordered by thread. threads has thread, last_ts and members (array).
    """
    rows = stored(threads.select("thread", "last_ts", "members"))
    time = F.unix_micros(F.col("last_ts").cast("timestamp")) if dict(rows.dtypes)["last_ts"].startswith("timestamp") else F.col("last_ts").cast("long")
    order = F.struct(F.coalesce(-time, F.lit(2**63 - 1)).alias("t"), F.col("thread"))
    sets = rows.where(F.size(F.array_distinct("members")) <= people).groupBy(F.array_sort(F.array_distinct("members")).alias("members")).agg(F.min(order).alias("at"))
    seen: dict[str, int] = {}
    taken: list = []
    while len(seen) < people:
        added = F.size(F.array_except("members", F.array(*map(F.lit, seen)).cast("array<string>")))
        found = sets.where((added > 0) & (added <= people - len(seen))).where(F.lit(True) if not taken else F.col("at") > _at(taken[-1])).orderBy("at").limit(block).collect()
        _fold(found, seen, taken, people)
        if len(found) < block:
            break
    if not taken:
        return rows.where(F.size("members") == 0).select("thread", F.size("members").alias("members"))
    # A person counts from the thread that added them; one who was never added from none.
    since = F.create_map(*[F.lit(x) for m, k in seen.items() for x in (m, k)])
    reached = sum((order >= _at(r)).cast("int") for r in taken)  # how many of the taken ones are not after a thread
    known = F.forall("members", lambda m: F.coalesce(F.element_at(since, m) < reached, F.lit(False)))
    inside = known & ((order <= _at(taken[-1])) if len(seen) >= people else F.lit(True))
    return rows.where(inside).select("thread", F.size("members").alias("members"))


def _at(row) -> Column:
    return F.struct(F.lit(row["at"]["t"]).cast("long").alias("t"), F.lit(row["at"]["thread"]).alias("thread"))


def thread_sets(people: DataFrame, group: str = "conv") -> DataFrame:
    """group, thread and size: groups of mentions (contact) with the same people have one thread, the least of them.

    A set is told by two sums of its members' hashes and their number, which partial aggregates merge, so no row grows with
    a group's members. Groups of one sum are then compared with the first of them, member by member; one that
    differs, by a clash of hashes, is a thread of its own.
    """
    each = stored(people.select(F.col(group).alias("group"), "contact").distinct())
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    marks = stored(each.groupBy("group").agg(F.count(F.lit(1)).alias("size"), whole(F.xxhash64("contact")).alias("a"), whole(F.xxhash64(F.lit(7), "contact")).alias("b")))
    first = marks.groupBy("size", "a", "b").agg(F.min("group").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = stored(marks.join(first, ["size", "a", "b"]).select("group", "size", "first", "n"))
    several = placed.where("n > 1 and group <> first")
    own = each.join(several.select("group", "first"), "group").select("first", "contact", "group")
    model = each.join(several.select(F.col("first").alias("group")).distinct(), "group").select(F.col("group").alias("first"), "contact")
    equal = own.join(model, ["first", "contact"]).groupBy("group").agg(F.count(F.lit(1)).alias("same"))
    return placed.join(equal, "group", "left").select("group", F.when((F.col("n") == 1) | (F.col("group") == F.col("first")) | (F.coalesce("same", F.lit(0)) == F.col("size")), F.col("first")).otherwise(F.col("group")).alias("thread"), "size")


def recent_threads(messages: DataFrame, contact_keys: DataFrame, people: int = 10, each: int = 5) -> DataFrame:
    """thread, name, url, message_count, last_ts, seq, ts, direction and body: the last messages of the most recent threads.

    contact_keys has contact_key, addresses and names of known contacts. Messages without a conversation
    are grouped by the people they name; conversations of the same people are one thread.
    """
    alike = stored(kinds(messages))
    named = stored(mentions(alike))
    known = stored(names_to_urls(named.where("not anonymous")))
    self = stored(owner(stored(identities(with_contacts(named.where("not anonymous"), known))), contact_keys))
    marked = named.crossJoin(F.broadcast(self)).withColumn("is_self", _is_self())
    others = marked.where("not is_self").drop("self_urls", "self_names", "is_self")
    known = known.unionByName(aliases(others.where("not anonymous"), alike, known))
    rows = stored(with_contacts(others, known))
    in_conv, conv_group = F.col("conv") != "", F.concat(F.lit("id:"), "conv")
    lone = rows.where(~in_conv).groupBy("row_idx").agg(F.concat(F.lit("people:"), F.array_join(F.array_sort(F.collect_set("contact")), "|")).alias("group"))
    grouped = lambda df: df.where(in_conv).withColumn("group", conv_group).unionByName(df.where(~in_conv).join(lone, "row_idx"))
    placed = grouped(rows)
    sets = stored(thread_sets(placed, "group").where(F.col("size") <= people))  # no budget takes a wider thread
    members = placed.join(sets.where("group = thread").select("group"), "group").groupBy(F.col("group").alias("thread")).agg(F.array_sort(F.collect_set("contact")).alias("members"))
    groups = stored(sets.select("group", "thread").join(members, "thread").select("group", "members", F.array_join("members", "|").alias("thread")))
    entries = grouped(alike.select("row_idx", "conv", "n", "ts"))
    totals = lambda df: df.groupBy("thread").agg(F.sum("n").alias("message_count"), F.max("ts").alias("last_ts"))
    threads = totals(entries.join(groups.select("group", "thread"), "group")).join(groups.select("thread", "members").dropDuplicates(["thread"]), "thread")
    chosen = stored(within_budget(threads, people).select("thread"))  # at most 2 ** people threads
    picked = small(stored(groups.select("group", "thread").join(F.broadcast(chosen), "thread")))
    who = placed.join(picked, "group")
    order = F.struct("row_idx", "pos")
    label = who.groupBy("thread", "contact").agg(F.min(order).alias("o"), F.min_by("name", F.when(F.col("name") != UNKNOWN, order)).alias("n"), F.min_by("url", F.when(F.col("url") != "", order)).alias("u"))
    label = label.select("thread", F.struct("o", F.coalesce("n", F.nullif("u", F.lit("")), F.lit(UNKNOWN)).alias("label")).alias("l"), F.coalesce("u", F.lit("")).alias("u"))
    label = label.groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["label"]), ", ").alias("name"), F.when(F.count(F.lit(1)) == 1, F.max("u")).otherwise("").alias("url"))
    at = F.when(in_conv, conv_group).otherwise(F.concat(F.lit("row:"), F.col("row_idx").cast("string")))
    where = small(stored(entries.join(picked, "group").select(at.alias("_at"), "thread").distinct()))  # conversations and lone rows of the chosen threads
    last = tail(messages.withColumn("_at", at).join(where, "_at").drop("_at"), "thread", "ts", "row_idx", each).crossJoin(F.broadcast(self))
    owned = F.array_contains("self_urls", F.col("sender_url")) | F.array_contains("self_names", X.name_key(F.col("sender")))
    direction = F.when(F.size("self_urls") + F.size("self_names") == 0, "unknown").when(owned, "sent").otherwise("received")
    counted = totals(entries.join(picked, "group"))
    return last.join(counted, "thread").join(F.broadcast(label), "thread").select("thread", "name", "url", "message_count", "last_ts", F.col("row_idx").alias("seq"), "ts", direction.alias("direction"), "body")
