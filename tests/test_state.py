"""The message state, thread sets, rows by place, sessions and the cube's one scan."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.functions.constants import NO_CONNECTIONS_TIP
from tracewell.operators import activity as A
from tracewell.operators import people as P
from tracewell.operators import threads as T
from tracewell.plans import relationships as R
from tracewell.plans import report as RP
from tracewell.streaming.sessions import sessions, stale

MAIL = "row_idx long, `CONVERSATION ID` string, FROM string, TO string, DATE string, CONTENT string, FOLDER string, `SENDER PROFILE URL` string, `RECIPIENT PROFILE URLS` string"


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


@pytest.fixture(scope="module")
def mail(spark):
    rng = random.Random(6)
    people = [(f"Person {k}", f"https://x/p{k}" if k % 2 else "") for k in range(8)]
    rows = []
    for i in range(120):
        other, me = rng.choice(people), ("Me", "https://x/me")
        a, b = (me, other) if rng.random() < 0.5 else (other, me)
        date = "" if i % 11 == 0 else f"2026-0{1 + i % 6}-1{i % 9} 10:{i % 60:02}:00 UTC"
        rows.append((i, f"c{i % 13}" if i % 5 else "", a[0], b[0], date, f"text {i}", "INBOX", a[1], b[1]))
    return spark.createDataFrame(rows, MAIL)


def test_state_is_what_its_parts_are(mail):
    state = R.message_state(mail)
    dated = R.messages_of(mail)
    events = R.events_of(dated)
    same(state["events"], events)
    same(state["contacts"], P.contacts(events))
    same(state["outreach"], R.outreach_of(dated))
    same(state["skipped"], R.message_facts(mail))
    same(state["unanswered"], R.outreach_of(dated).select("unanswered_contacts"))
    assert state["owner"].first().url == "https://x/me" and state["owner"].first().name_key == "me"
    facts = state["facts"].first()
    assert (facts.messages, facts.people, facts.mentions) == (dated.count(), events.select("contact").distinct().count(), events.count())
    assert {r.contact_key for r in state["talked"].collect()} == {x for r in events.collect() for x in (r.url, r.name_key) if x}
    assert {r.name_key for r in state["names"].collect()} >= {"me", "person 1"}


def test_tip_asks_for_connections(spark, mail):
    lists = R.panels(R.messages_of(mail), R.connections_of(spark.createDataFrame([(0, "Person", "1", "https://x/p1", "", "Co", "Pos", "2025-01-05")], "row_idx long, `First Name` string, `Last Name` string, URL string, `Email Address` string, Company string, Position string, `Connected On` string")), "2027-01-01")
    top = lists["top"].select(F.col("Name").alias("name"), F.col("Messages").alias("n"), F.col("Last Message").alias("last_ts"))
    fading = lists["fading"].select(F.col("Name").alias("name"), F.col("Days Since").alias("days_since"), F.col("Last Message").alias("last_ts"))
    tip = RP.message_tip(top, lists["silent"], fading).first().tip
    assert tip.startswith(top.first().name) and fading.first().name in tip
    assert RP.message_tip(top, lists["silent"], fading, connections=False).first().tip == NO_CONNECTIONS_TIP


def test_thread_sets_are_sets(spark, monkeypatch):
    rng = random.Random(2)
    groups = {f"g{k:03}": set(rng.sample("abcd", rng.randint(1, 4))) for k in range(60)}
    rows = spark.createDataFrame([(g, c) for g, s in groups.items() for c in s for _ in range(rng.randint(1, 2))], "conv string, contact string")
    first = {}
    for g, s in sorted(groups.items()):
        first.setdefault(frozenset(s), g)
    expected = {g: (first[frozenset(s)], len(s)) for g, s in groups.items()}
    assert {r.group: (r.thread, r["size"]) for r in T.thread_sets(rows).collect()} == expected
    monkeypatch.setattr(T.F, "xxhash64", lambda *c: F.lit(1).cast("long"))  # all hashes clash: sizes alone agree
    got = {r.group: r.thread for r in T.thread_sets(rows).collect()}
    threads = defaultdict(set)
    for g, t in got.items():
        threads[t].add(frozenset(groups[g]))
    assert all(len(s) == 1 for s in threads.values())


@pytest.mark.parametrize("seed, block", [(1, 1), (2, 3), (3, 4096)])
def test_budget_in_blocks(spark, seed, block):
    rng = random.Random(seed)
    rows = [(f"t{i:02}", rng.randint(0, 30), sorted(rng.sample("abcdefghij", rng.randint(0, 5)))) for i in range(80)]
    seen, expected = set(), set()
    for t, _, m in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(seen | set(m)) > 6:
            continue
        seen |= set(m)
        expected.add(t)
        if len(seen) == 6:
            break
    got = T.within_budget(spark.createDataFrame(rows, "thread string, last_ts long, members array<string>"), 6, block)
    assert {r.thread for r in got.collect()} == expected


def test_rows_by_place(spark):
    a = spark.createDataFrame([(k, "x", None) for k in range(50)], "a long, b string, c string").repartitionByRange(3, "a").sortWithinPartitions("a")
    b = spark.createDataFrame([(k, "y" if k in (7, 31) else "x", "z" if k == 31 else None) for k in range(52)], "n long, m string, c string").repartitionByRange(4, "n").sortWithinPartitions("n")
    counts, places = P.positional_diff(a, b, 2)
    assert tuple(counts.first()) == (2, 3, 0, 2) and [tuple(r) for r in places.orderBy("row", "column").collect()] == [(7, 1, "x", "y"), (31, 1, "x", "y")]
    counts, places = P.positional_diff(a.select("a"), b)
    assert tuple(counts.first()) == (50, 51, 0, 2) and places.count() == 3
    assert tuple(P.positional_diff(a.limit(0), a.limit(0))[0].first()) == (0, 0, 0, 0)


def test_a_silent_session_expires(spark, tmp_path):
    start = datetime(2026, 1, 1)
    batches = [[("ada", 0), ("ada", 5), ("bob", 6)], [("bob", 26)], [("bob", 49), ("eve", 60)], [("eve", 61)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame([(u, start + timedelta(hours=h)) for u, h in batch], "user string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
    schema = "user string, ts timestamp"
    seen = []
    for k in range(len(batches)):
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"b{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        stream = sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "user")
        query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
        if k == 0:
            assert not seen
    hour = lambda h: start + timedelta(hours=h)
    assert ("ada", hour(0), hour(5), 2) in seen and all(r[0] != "eve" for r in seen)
    one = spark.createDataFrame([(1, hour(0)), (2, hour(1)), (3, None)], "k int, ts timestamp")
    assert [r.x for r in one.select("k", stale(F.col("ts"), F.lit(hour(24) + timedelta(minutes=1))).alias("x")).orderBy("k").collect()] == [True, False, True]


def test_the_cube_scans_events_once(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    act = events.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit("post").alias("kind"), F.lit("media").alias("share_type"), F.array("event_type").alias("topics"), F.col("event_id").alias("row_idx"))
    plan = A.cube_cells(act)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "Scan parquet" not in A.cube(act)["topics"]._jdf.queryExecution().executedPlan().toString()
    for name, one in (("totals", A.month_totals), ("topics", A.month_topics), ("hours", A.month_hours), ("share_types", A.month_share_types), ("days", A.day_totals)):
        same(A.cube(act)[name], one(act))
    assert A.cube(act.limit(0))["facts"].first().total == 0
