"""Report tables, message counts and filters on rows made by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_relationships import MESSAGES
from tracewell import queries
from tracewell.functions import labels as L
from tracewell.functions import text as X
from tracewell.operators import activity as A
from tracewell.operators import messages as M
from tracewell.operators import people as P
from tracewell.plans import export
from tracewell.plans import relationships as R
from tracewell.plans import report as RP

ROWS = "row_idx long, ts timestamp_ntz"


def test_message_counts(spark):
    rows = spark.createDataFrame([(0, None), (1, datetime(2026, 1, 5)), (2, datetime(2026, 3, 5)), (3, datetime(2026, 3, 6))], ROWS)
    people = spark.createDataFrame([(0,), (1,), (1,), (3,)], "row_idx long")
    assert tuple(M.skipped(rows, people).first()) == (1, 1, 2) and tuple(M.skipped(rows.limit(0), people).first()) == (0, 0, 0)
    assert sorted(map(tuple, M.monthly(rows, "3m").collect())) == [("2026-01", 1), ("2026-02", 0), ("2026-03", 2)]
    assert M.monthly(rows, "all").count() == 0 and M.monthly(rows.limit(0)).count() == 0
    events = spark.createDataFrame([(1, datetime(2026, 1, 5), "a"), (2, datetime(2026, 3, 5), "a"), (2, datetime(2026, 3, 5), "b")], ROWS + ", contact string")
    assert M.range_totals(events, "1m").first().asDict() == {"messages": 1, "mentions": 2, "people": 2}
    assert M.range_totals(events, "all").first().asDict() == {"messages": 2, "mentions": 3, "people": 2}
    assert M.most_frequent(spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "row_idx long, k string"), "k").first().k == "b"
    sides = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", False)], "contact string, is_self boolean")
    assert M.unanswered(sides).first()[0] == 1 and M.unanswered(sides.limit(0)).first()[0] == 0


def test_outreach_of_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text(MESSAGES)
    rows = export.cleaned(spark, str(tmp_path / "m.csv"))
    got = R.outreach_of(R.messages_of(rows)).first()
    # the owner began c1, which was answered, and c3, to someone without a name; Bob began c2
    assert (got.conversations, got.self_initiated, got.replied, got.sent, got.received, got.unanswered_contacts) == (3, 2, 1, 2, 2, 0)
    assert R.message_facts(rows).first().asDict() == {"undated": 1, "nobody": 1, "skipped": 2}


def test_nameless_senders_do_not_reply(spark):
    talk = spark.createDataFrame([("c", datetime(2026, 1, 1), 0, True), ("c", datetime(2026, 1, 2), 1, None), ("d", datetime(2026, 1, 1), 2, None)], "conv string, ts timestamp_ntz, row_idx long, is_self boolean")
    got = P.outreach(talk).first()
    assert (got.conversations, got.self_initiated, got.others_initiated, got.replied, got.sent, got.received) == (2, 1, 1, 0, 1, 0)


def test_months_as_written(spark):
    rows = spark.createDataFrame([("2026-01-05",), ("2026-01",), ("2026-99-1",), ("-01-02",), ("2026-",), ("",), (None,)], "d string")
    assert {tuple(r) for r in P.months_as_written(rows, "d").collect()} == {("2026-01", 2), ("2026-99", 1)}


def test_tiles_and_captions(spark):
    facts = spark.createDataFrame([(3, "-", " 0 ", None)], "a long, b string, c string, d string")
    rows = RP.tiles(facts, ("A", F.col("a")), ("B", F.col("b")), ("D", F.col("d")), ("C", F.col("c")))
    assert [tuple(r) for r in rows.orderBy("position").collect()] == [(0, "A", "3"), (1, "B", "-"), (2, "C", " 0 ")]
    assert [r.label for r in RP.measured(rows).collect()] == ["A"]
    month = lambda *m: spark.createDataFrame([(x,) for x in m], "month string")
    assert RP.caption(month("2025-02", "2024-12")).first()[0] == "Dec 2024 to Feb 2025" and RP.caption(month("2025-02")).first()[0] == "Feb 2025" and RP.caption(month(), "none").first()[0] == "none"
    assert RP.has_data(rows) and RP.has_data(rows, "position") and not RP.has_data(rows.where("position = 0"), "position") and not RP.has_data(rows.limit(0))


@pytest.mark.parametrize("top, fading, silent, tip", [
    (True, True, 2, "Ada is your liveliest thread. I would say hello to Bob too, quiet for 40 days now."),
    (True, False, 2, "Ada is your top contact in this range. I would keep that rhythm going."),
    (False, True, 1, "I count 1 silent connection. One short hello can wake the list up."),
    (False, False, 2, "I count 2 silent connections. One short hello can wake the list up."),
    (False, False, 0, None),
])
def test_message_tip(spark, top, fading, silent, tip):
    contacts = spark.createDataFrame([("Ada", 5, 2), ("Cy", 5, 1)] if top else [], "name string, n long, last_ts long")
    faded = spark.createDataFrame([("Bob", 40, 3), ("Di", 50, 1)] if fading else [], "name string, days_since long, last_ts long")
    assert [r.tip for r in RP.message_tip(contacts, spark.range(silent), faded).collect()] == [tip]


def test_all_time_tiles(spark):
    outreach = spark.createDataFrame([(3, None, 2, 1.25)], "self_initiated long, reply_rate double, unanswered_contacts long, sent_received_ratio double")
    growth = spark.createDataFrame([(4, True)], "multiplier long, shown boolean")
    got = [(r.label, r.value) for r in RP.all_time_tiles(growth, outreach).orderBy("position").collect()]
    assert got[0] == ("Network growth", "4×") and got[2] == ("Reply rate", "N/A") and got[3] == ("Unanswered", "2")
    assert RP.all_time_tiles(growth.withColumn("shown", F.lit(False)), outreach).count() == 4


def test_filters_of_a_route():
    assert A.Filters.parse({}) == A.Filters()
    assert A.Filters.parse({"range": "3M", "topic": " ai ", "month": "2026-05", "day": "0", "hour": 23, "shareType": "media"}) == A.Filters("3m", "ai", "2026-05", 0, 23, "media")
    assert A.Filters.parse({"range": "2y", "topic": " ", "month": "2026-5", "day": "7", "hour": "-1", "shareType": None}) == A.Filters()
    week = A.Filters().toggle(week="2026-05-04")
    assert week.month == "2026-05" and week.toggle(month="2026-05") == A.Filters()
    both = A.Filters().toggle(day=1, hour=2)
    assert (both.day, both.hour) == (1, 2) and both.toggle(day=1, hour=3).hour == 3 and both.toggle(day=1, hour=2) == A.Filters()
    assert [L.range_key(x) for x in ("ALL", "6m", "x", None)] == ["all", "6m", "12m", "12m"]
    assert [L.limit_of(x, 7) for x in ("3.9", 1, 0, "x", None, float("inf"))] == [3, 1, 7, 7, 7, 7]
    assert L.range_label("3m") == "Last 3 months" and L.range_label("x") == "Last 12 months"


def test_view_without_activity(spark):
    none = spark.createDataFrame([], "ts timestamp_ntz, kind string, share_type string, topics array<string>, row_idx long")
    view = A.view(A.cube(none), A.Filters())
    assert tuple(view["totals"].first()) == (0, 0, 0) and tuple(view["peaks"].first()) == (0, 0) and tuple(view["streaks"].first()) == (0, 0) and view["timeline_max"].first()[0] == 1
    assert RP.activity_tiles(view).count() == 0 and view["timeline"].count() == 0 and view["topics"].count() == 0


def test_hashtags(spark):
    row = spark.createDataFrame([("#Größe und #a_1 ##b #A_1",), (None,)], "t string").select(X.hashtags(F.col("t")).alias("h")).collect()
    assert row[0].h == ["größe", "a_1", "b", "a_1"] and row[1].h == []


def test_report_takes_people_from_messages_once(spark, monkeypatch):
    """Lists, tiles and the funnel share one table of people and one of events."""
    made = []
    monkeypatch.setattr(P, "participants", lambda *a, whole=P.participants: made.append(1) or whole(*a))
    queries._report(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
