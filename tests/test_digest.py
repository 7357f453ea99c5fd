"""The digest of a table, people named twice, blank keys, and ranges that are none."""

from pyspark.sql import functions as F

from tracewell.operators import activity, people


def test_digest_counts_rows_that_repeat(spark):
    of = lambda *rows: people.digest(spark.createDataFrame([(x, None) for x in rows], "a string, `b.c` long")).first()
    assert of("a", "a") != of("b", "b") and of("a", "b") == of("b", "a") and of("a", "a").rows == 2


def test_a_person_named_twice_counts_once(spark):
    rows = [(1, "from", "Al", "al", "u/al", 1), (1, "to", "Bob", "bob", "", 1), (1, "to", "Bob B", "bob", "u/bob", 1), (2, "to", "Bob", "bob", "", 2)]
    got = people.contacts(people.canonical_contacts(spark.createDataFrame(rows, "row_idx long, role string, name string, name_key string, url string, ts long"))).collect()
    assert {r.contact: r.n for r in got} == {"url:u/al": 1, "url:u/bob": 2}


def test_blank_keys_match_nothing(spark):
    conn = spark.createDataFrame([(i, "", "") for i in range(50)] + [(50, "u/a", "a")], "row_idx long, url string, name_key string")
    rows = spark.createDataFrame([("c1", "", ""), ("c2", "u/a", ""), ("c3", "", "a")], "contact string, url string, name_key string")
    assert {r.contact: r.connection for r in people.match_connections(rows, conn).collect()} == {"c1": None, "c2": 50, "c3": 50}
    silent = people.silent(conn, rows.select("url").distinct(), rows.select("name_key").distinct())
    assert silent.count() == 50 and silent.columns == conn.columns


def test_unknown_range_is_an_empty_view(spark):
    totals = spark.createDataFrame([("2024-01", 1)], "month string, posts long")
    assert activity.months_of(totals, "5y").count() == 0 and activity.months_of(totals, "all").count() == 1


def test_digest_tells_values_apart(spark):
    of = lambda *row: people.digest(spark.createDataFrame([row], "a string, b string")).first().digest
    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "c"), ("\x01", "c"), ("-", "c"), ("", "c"), ("1:", "c"), ("", "1:c"), ("-1:c", ""), (None, None), ("é", "c")]
    assert len({of(*r) for r in rows}) == len(rows)
