"""Threads of a small mailbox, and the people budget against a plain loop."""

import random
from datetime import datetime

import pytest

from tracewell.functions.constants import ANONYMOUS
from tracewell.operators import threads
from tracewell.operators.threads import recent_threads, within_budget

SCHEMA = "row_idx long, conv string, ts timestamp_ntz, sender string, sender_url string, names array<string>, urls array<string>, several boolean, body string"
ME = ("Me", "https://x/me")


def mail(spark, rows):
    made = []
    for i, (conv, sender, to, body) in enumerate(rows):
        made.append((i, conv, datetime(2026, 1, 1 + i), sender[0], sender[1], [n for n, _ in to], [u for _, u in to if u], len(to) > 1, body))
    return spark.createDataFrame(made, SCHEMA)


def threads_of(spark, rows, contacts=(), **options):
    keys = spark.createDataFrame([(c,) for c in contacts], "contact_key string")
    got = {}
    for r in recent_threads(mail(spark, rows), keys, **options).orderBy("last_ts", "seq").collect():
        got.setdefault((r["name"], r.url, r.message_count), []).append((r.direction, r.body))
    return got


def test_threads_fold_by_people(spark):
    ada, bob = ("Ada", "https://x/ada"), ("Bob", "https://x/bob")
    rows = [("1", ME, [ada], "a"), ("1", ada, [ME], "b"), ("2", ada, [ME], "c"), ("3", ME, [ada, bob], "d"), ("", bob, [ME], "e"), ("4", ("Ada L.", ""), [ME], "f"), ("4", ada, [ME], "g")]
    assert threads_of(spark, rows) == {
        ("Ada", "https://x/ada", 5): [("sent", "a"), ("received", "b"), ("received", "c"), ("received", "f"), ("received", "g")],
        ("Ada, Bob", "", 1): [("sent", "d")],
        ("Bob", "https://x/bob", 1): [("received", "e")],
    }
    assert threads_of(spark, rows, each=1)["Ada", "https://x/ada", 5] == [("received", "g")]
    assert set(threads_of(spark, rows, people=1)) == {("Ada", "https://x/ada", 5)}


def test_owner_stays_open_on_a_tie_unless_contacts_tell(spark):
    ada = ("Ada", "https://x/ada")
    rows = [("1", ME, [ada], "a")]
    assert threads_of(spark, rows) == {("Me, Ada", "", 1): [("unknown", "a")]}
    assert threads_of(spark, rows, contacts=["https://x/ada"]) == {("Ada", "https://x/ada", 1): [("sent", "a")]}


def test_people_without_names(spark):
    nobody = (ANONYMOUS.title(), "")
    rows = [("1", nobody, [ME], "a"), ("2", nobody, [ME], "b"), ("", nobody, [ME], "c")]
    got = threads_of(spark, rows)
    assert sorted(v for x in got.values() for v in x) == [("received", "a"), ("received", "b")] and len(recent_threads(mail(spark, rows), spark.createDataFrame([], "contact_key string")).select("thread").distinct().collect()) == 2
    assert recent_threads(mail(spark, rows).limit(0), spark.createDataFrame([], "contact_key string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_budget_is_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"t{i}", rng.randint(0, 9), sorted(rng.sample("abcdefgh", rng.randint(1, 4)))) for i in range(30)]
    seen, expected = set(), set()
    for t, _, m in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(seen | set(m)) > 5:
            continue
        seen |= set(m)
        expected.add(t)
        if len(seen) == 5:
            break
    got = within_budget(spark.createDataFrame(rows, "thread string, last_ts long, members array<string>"), 5)
    assert {r.thread for r in got.collect()} == expected


def test_messages_alike_are_counted_once_read(spark, monkeypatch):
    """People are looked up by kinds of messages, not message by message."""
    ada = ("Ada", "https://x/ada")
    rows = [("1", ME, [ada], f"a{k}") if k % 3 else ("1", ada, [ME], f"a{k}") for k in range(24)] + [("", ada, [ME], "b"), ("", ada, [ME], "c")]
    looked = []
    monkeypatch.setattr(threads, "mentions", lambda found, whole=threads.mentions: looked.append(found.count()) or whole(found))
    assert threads_of(spark, rows, contacts=["https://x/ada"]) == {("Ada", "https://x/ada", 26): [("received", "a21"), ("sent", "a22"), ("sent", "a23"), ("received", "b"), ("received", "c")]}
    assert looked == [4]
