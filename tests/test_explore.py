"""The explorer's aggregates on rows made by hand."""

from tracewell.operators import explore as E


def test_explorer(spark):
    months = spark.createDataFrame([(f"2026-0{m}", m % 4, m) for m in range(1, 10)], "month string, posts long, comments long")
    assert {r.month: r.ratio for r in E.comments_per_post(months).collect()} == {"2026-02": 1.0, "2026-03": 1.0, "2026-05": 5.0, "2026-06": 3.0, "2026-07": 2.3, "2026-09": 9.0}
    mails = spark.createDataFrame([("a@x",), (" ",), (None,)], "email string")
    assert tuple(E.visible(mails, "email").first()) == (3, 1, 33) and tuple(E.visible(mails.limit(0), "email").first()) == (0, 0, 0)
    assert {tuple(r) for r in E.histogram(mails, "email").collect()} == {("a@x", 1), (" ", 1), ("?", 1)}
    talk = spark.createDataFrame([("1", 0, True), ("1", 1, False), ("2", 2, False), ("2", 3, True)], "conv string, row_idx long, is_self boolean")
    assert tuple(E.initiated(talk).first()) == (2, 1)
    rows = [(0, True, "me", "b"), (1, True, "me", "a, b"), (2, True, "me", "a"), (3, True, "me", ""), (4, False, "c", "me"), (5, False, " c", "me, a"), (6, False, "", "me")]
    got = E.top_sides(spark.createDataFrame(rows, "row_idx long, is_self boolean, sender string, recipients string")).collect()
    assert {tuple(r) for r in got} == {("outbound", "b", 1, 0), ("outbound", "a", 1, 2), ("inbound", "c", 2, 4)}
    one = E.top_sides(spark.createDataFrame(rows, "row_idx long, is_self boolean, sender string, recipients string"), 1).collect()
    assert {r["name"] for r in one} == {"b", "c"}
