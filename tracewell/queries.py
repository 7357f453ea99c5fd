"""The registered queries over the driver's tables and the SQL each is held against.

Activity is made of orders (posts: status F; share type and topics from the priority, hours from
the key), messages of orders between customers and of conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import dates as D
from tracewell.functions import labels as LB
from tracewell.functions import text as X
from tracewell.functions.constants import CARDS, MISSING, NOTES, SHIFTS, STOP_WORDS
from tracewell.operators import activity as A
from tracewell.operators import explore as E
from tracewell.operators import messages as M
from tracewell.operators import people as P
from tracewell.operators import threads as T
from tracewell.operators.ordinal import with_place
from tracewell.operators.stored import stored
from tracewell.plans import export as EX
from tracewell.plans import relationships as R
from tracewell.plans import report as RP
from tracewell.plans.insights import insights, with_texts
from tracewell.streaming import sessions as SE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2001-09-01"


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    ts = F.expr("o_orderdate + make_interval(0, 0, 0, 0, cast(pmod(o_orderkey * 7, 24) as int), 0, 0)").cast("timestamp_ntz")
    kind = F.when(F.col("o_orderstatus") == "F", "post").otherwise("comment")
    share = F.when(F.col("o_orderpriority") == "1-URGENT", "media").when(F.col("o_orderpriority") == "2-HIGH", "links").otherwise("textOnly")
    topics = F.array(F.lower(F.substring("o_orderpriority", 3, 20)), F.concat(F.lit("tag"), (F.col("o_custkey") % 7).cast("string")))
    return o.select(ts.alias("ts"), kind.alias("kind"), share.alias("share_type"), topics.alias("topics"), F.col("o_orderkey").alias("row_idx"))


_ACT = """act as (select o_orderdate + to_hours((o_orderkey * 7 % 24)::int) as ts, case when o_orderstatus = 'F' then 'post' else 'comment' end as kind,
  case o_orderpriority when '1-URGENT' then 'media' when '2-HIGH' then 'links' else 'textOnly' end as share_type,
  [lower(substring(o_orderpriority, 3, 20)), 'tag' || (o_custkey % 7)] as topics from orders),
mt as (select strftime(ts, '%Y-%m') as month, count(*) filter (where kind = 'post') as posts, count(*) filter (where kind = 'comment') as comments, count(*) as total from act group by 1),
mtop as (select strftime(ts, '%Y-%m') as month, unnest(list_distinct(topics)) as topic from act), mtopic as (select month, topic, count(*) as n from mtop group by all),
mh as (select strftime(ts, '%Y-%m') as month, isodow(ts) - 1 as dow, hour(ts) as hour, count(*) as n from act group by all),
ms as (select strftime(ts, '%Y-%m') as month, share_type, count(*) as n from act where kind = 'post' group by all),
dt as (select strftime(ts, '%Y-%m-%d') as day, count(*) filter (where kind = 'post') as posts, count(*) filter (where kind = 'comment') as comments, count(*) as total,
  count(*) filter (where kind = 'post' and share_type = 'textOnly') as "n_textOnly", count(*) filter (where kind = 'post' and share_type = 'links') as n_links, count(*) filter (where kind = 'post' and share_type = 'media') as n_media from act group by 1)"""


def _months(n: int | None) -> str:
    a = "min(month)" if n is None else "max(month)"
    back = "" if n is None else f" - interval {n - 1} month"
    return f"cal as (select strftime(unnest(generate_series((select ({a} || '-01')::date{back} from mt)::timestamp, (select (max(month) || '-01')::date from mt)::timestamp, interval 1 month)), '%Y-%m') as month)"


@query(f"with {_ACT} select * from mt")
def month_totals(spark, sf):
    return A.month_totals(activity(spark, sf))


@query(f"with {_ACT} select * from mtopic")
def month_topics(spark, sf):
    return A.month_topics(activity(spark, sf))


@query(f"with {_ACT} select month, dow::int as dow, hour::int as hour, n from mh")
def month_hours(spark, sf):
    return A.month_hours(activity(spark, sf))


@query(f"with {_ACT} select * from ms")
def month_share_types(spark, sf):
    return A.month_share_types(activity(spark, sf))


@query(f"with {_ACT} select * from dt")
def day_totals(spark, sf):
    return A.day_totals(activity(spark, sf))


@query(f"with {_ACT}, {_months(None)} select month, coalesce(posts, 0) as posts, coalesce(comments, 0) as comments, coalesce(total, 0) as total from cal left join mt using (month)")
def timeline_all(spark, sf):
    return A.timeline(A.month_totals(activity(spark, sf)))


@query(f"with {_ACT}, {_months(12)} select month, coalesce(posts, 0) as posts, coalesce(comments, 0) as comments, coalesce(total, 0) as total from cal left join mt using (month)")
def timeline_12m(spark, sf):
    return A.timeline(A.month_totals(activity(spark, sf)), "12m")


@query("select count(*) filter (where o_orderstatus = 'F') as posts, count(*) filter (where o_orderstatus <> 'F') as comments, count(*) as total, count(distinct o_orderdate::date) as active_days, strftime(min(o_orderdate), '%Y-%m-%d') as first_day, strftime(max(o_orderdate), '%Y-%m-%d') as last_day from orders")
def activity_totals(spark, sf):
    return A.totals(activity(spark, sf))


@query("select (isodow(ts) - 1)::int as dow, hour(ts)::int as hour, count(*) as n from events group by all")
def heatmap_dow_hour(spark, sf):
    return A.heatmap(_table(spark, sf, "events"))


@query("""with h as (select hour(ts)::int as k, count(*) as n from events group by 1), d as (select (isodow(ts) - 1)::int as k, count(*) as n from events group by 1)
select (select k from h order by n desc, k limit 1) as peak_hour, (select k from d order by n desc, k limit 1) as peak_day""")
def peaks(spark, sf):
    grid = stored(A.heatmap(_table(spark, sf, "events")))
    return A.peak(grid, "hour", "peak_hour").crossJoin(A.peak(grid, "dow", "peak_day"))  # of one row each


@query("""with d as (select distinct user_id, ts::date as d from events),
r as (select *, d - (row_number() over (partition by user_id order by d))::int as run from d), g as (select user_id, run, count(*) as n, max(d) as last from r group by all)
select user_id, max(n) as longest, arg_max(n, last) as current from g group by user_id""")
def streaks(spark, sf):
    e = _table(spark, sf, "events")
    return A.streaks(e.select("user_id", F.col("ts").cast("date").alias("d")), ["user_id"])


_TREND = """r as (select *, row_number() over (order by month) as k, count(*) over () as n from line)"""


@query(f"""with {_ACT}, {_months(12)}, line as (select month, coalesce(total, 0) as total from cal left join mt using (month)), {_TREND},
s as (select sum(total) filter (where k <= n // 2)::bigint as older, sum(total) filter (where k > n // 2)::bigint as recent from r), p as (select *, (recent - older) / older::double * 100.0 as percent from s)
select older, recent, percent, case when percent > 8 then 'up' when percent < -12 then 'down' else 'flat' end as direction from p""")
def trend(spark, sf):
    return A.trend(A.timeline(A.month_totals(activity(spark, sf)), "12m"))


@query(f"""with {_ACT}, {_months(None)}, line as (select month, coalesce(posts, 0) as posts, coalesce(comments, 0) as comments from cal left join mt using (month)), {_TREND},
s as (select sum(comments) filter (where k <= n // 2) / (sum(posts) filter (where k <= n // 2))::double as prior, sum(comments) filter (where k > n - n // 2) / (sum(posts) filter (where k > n - n // 2))::double as recent from r where n >= 6)
select prior, recent, case when recent / prior >= 1.5 then 'more-engaging' when recent / prior <= 0.6 then 'more-posting' end as direction from s""")
def ratio_trend(spark, sf):
    return A.ratio_trend(A.timeline(A.month_totals(activity(spark, sf))))


@query(f"""with {_ACT}, r as (select month, row_number() over (order by month) as k, count(*) over () as n from mt),
p as (select month, case when k <= n // 3 then 'from' when k > n - n // 3 then 'to' end as part from r), c as (select part, topic, sum(n) as n from mtopic join p using (month) where part is not null group by all),
b as (select part, topic, row_number() over (partition by part order by n desc, topic) as x from c), o as (select max(topic) filter (where part = 'from') as from_topic, max(topic) filter (where part = 'to') as to_topic from b where x = 1)
select * from o where from_topic <> to_topic""")
def topic_shift(spark, sf):
    a = activity(spark, sf)
    return A.topic_shift(A.month_totals(a), A.month_topics(a))


@query("""with p as (select strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders group by 1), c as (select strftime(l_shipdate, '%Y-%m') as month, count(*) as n from lineitem group by 1),
cal as (select strftime(unnest(generate_series((select greatest((select min(month) from p), (select min(month) from c)) || '-01')::timestamp, (select least((select max(month) from p), (select max(month) from c)) || '-01')::timestamp, interval 1 month)), '%Y-%m') as month),
r as (select month, coalesce(p.n, 0)::double as p, coalesce(c.n, 0)::double as c from cal left join p using (month) left join c using (month)), b as (select *, row_number() over (order by p desc, month) as busy from r),
f as (select count(*) as months, covar_pop(p, c) as cov, var_pop(p) * var_pop(c) as var, floor(coalesce(avg(c) filter (where p <= 2), 0) + 0.5)::bigint as quiet_avg, floor(coalesce(avg(c) filter (where busy <= 10), 0) + 0.5)::bigint as top_avg from b),
g as (select *, case when var > 0 then cov / sqrt(var) end as corr, case when quiet_avg > 0 then floor(top_avg / quiet_avg::double + 0.5)::bigint else 0 end as multiplier from f)
select months, floor(corr * 100 + 0.5)::bigint / 100::double as corr, quiet_avg, top_avg, multiplier, months >= 12 and coalesce(corr, 0) > 0 and multiplier >= 2 as shown from g""")
def network_growth(spark, sf):
    by = lambda t, c: t.groupBy(D.month_key(F.col(c)).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return A.growth(by(_table(spark, sf, "orders"), "o_orderdate"), by(_table(spark, sf, "lineitem"), "l_shipdate"))


@query(ORACLES["network_growth"])
def network_growth_whole(spark, sf):
    """The query under the name that it had while network_growth kept a slice; so are the others of this kind."""
    return network_growth(spark, sf)


def _filtered_sql(n, topic=None, share=None, day=None, hour=None) -> str:
    rnd = lambda e: f"floor({e} + 0.5::double)::bigint"
    sql = f"with {_ACT}, {_months(n)}, f0 as (select month, posts, comments, total, posts as ap, total as alltot from cal join mt using (month))"
    at = 0
    if topic:
        sql += f", f1 as (select f.month, {rnd('posts * (t.n / alltot::double)')} as posts, {rnd('comments * (t.n / alltot::double)')} as comments, t.n as total, ap, alltot from f0 f join mtopic t on f.month = t.month and t.topic = '{topic}')"
        at = 1
    if share:
        sql += f", f2 as (select f.month, {rnd('posts * (case when ap > 0 then coalesce(s.n, 0) / ap::double else 0 end)')} as posts, 0::bigint as comments, ap, alltot from f{at} f left join ms s on f.month = s.month and s.share_type = '{share}'), f3 as (select *, posts as total from f2)"
        at = 3
    if day is not None or hour is not None:
        where = " and ".join([f"dow = {day}"] * (day is not None) + [f"hour = {hour}"] * (hour is not None))
        sql += f", h as (select month, coalesce(sum(n) filter (where {where}), 0) as hit from mh group by 1), f4 as (select f.month, {rnd('posts * (hit / alltot::double)')} as posts, {rnd('comments * (hit / alltot::double)')} as comments, {rnd('total * (hit / alltot::double)')} as total from f{at} f join h using (month))"
        at = 4
    return sql + f", kept as (select * from f{at} where total <> 0)"


def _view_query(name: str, f: A.Filters, component: str, sql: str) -> None:
    def run(spark, sf):
        return A.view(A.cube(activity(spark, sf)), f)[component]

    QUERIES[name], ORACLES[name] = run, sql


_LINE = " select month, coalesce(posts, 0) as posts, coalesce(comments, 0) as comments, coalesce(total, 0) as total from cal left join kept using (month)"
_view_query("view_topic_timeline", A.Filters("12m", topic="urgent"), "timeline", _filtered_sql(12, topic="urgent") + _LINE)
_view_query("view_share_type_timeline", A.Filters("6m", share_type="links"), "timeline", _filtered_sql(6, share="links") + _LINE)
_view_query("view_day_timeline", A.Filters("12m", day=2), "timeline", _filtered_sql(12, day=2) + _LINE)
_view_query("view_hour_timeline", A.Filters("all", hour=7), "timeline", _filtered_sql(None, hour=7) + _LINE)
_view_query("view_combined_timeline", A.Filters("all", topic="tag3", share_type="media", day=1), "timeline", _filtered_sql(None, topic="tag3", share="media", day=1) + _LINE)
_view_query("view_totals", A.Filters("all", topic="high", day=4, hour=14), "totals", _filtered_sql(None, topic="high", day=4, hour=14) + " select coalesce(sum(posts), 0)::bigint as posts, coalesce(sum(comments), 0)::bigint as comments, (coalesce(sum(posts), 0) + coalesce(sum(comments), 0))::bigint as total from kept")
_view_query("view_heatmap", A.Filters("3m", topic="low"), "heatmap", _filtered_sql(3, topic="low") + " select dow::int as dow, hour::int as hour, sum(n)::bigint as n from mh semi join kept using (month) group by all")
_view_query("view_topics_top12", A.Filters("12m"), "topics", _filtered_sql(12) + " select topic, sum(n)::bigint as n from mtopic semi join kept using (month) group by topic order by n desc, topic limit 12")
_view_query("view_content_mix", A.Filters("12m"), "content_mix", _filtered_sql(12) + " select share_type, sum(n)::bigint as n from ms semi join kept using (month) group by share_type")
_view_query("view_active_days", A.Filters("3m"), "active_days", _filtered_sql(3) + " select day from dt semi join kept on dt.day[1:7] = kept.month")

_view_query("view_timeline_max", A.Filters("12m", topic="urgent"), "timeline_max", f"with {_ACT}, {_months(12)} select greatest(1, coalesce(max(total), 1))::bigint as timeline_max from mt semi join cal using (month)")
_view_query("view_trend", A.Filters("12m", topic="urgent"), "trend", _filtered_sql(12, topic="urgent") + f", line as ({_LINE}), r as (select *, row_number() over (order by month) as k, count(*) over () as n from line), s as (select sum(total) filter (where k <= n // 2)::bigint as older, sum(total) filter (where k > n // 2)::bigint as recent from r), p as (select *, (recent - older) / older::double * 100.0 as percent from s) select older, recent, percent, case when percent > 8 then 'up' when percent < -12 then 'down' else 'flat' end as direction from p")
_view_query("view_peaks", A.Filters("6m", topic="low"), "peaks", _filtered_sql(6, topic="low") + ", x as (select * from mh semi join kept using (month)) select (select hour from x group by hour order by sum(n) desc, hour limit 1)::int as peak_hour, (select dow from x group by dow order by sum(n) desc, dow limit 1)::int as peak_day")
_view_query("view_streaks", A.Filters("all", topic="tag3"), "streaks", _filtered_sql(None, topic="tag3") + ", d as (select day::date as d, day::date - (row_number() over (order by day))::int as run from dt semi join kept on dt.day[1:7] = kept.month), g as (select run, count(*) as n, max(d) as last from d group by 1) select max(n) as longest, arg_max(n, last) as current from g")


def _weeks_sql(n: int, value: str, ratios: str = "", join: str = "") -> str:
    return f"""with {_ACT}, {_months(n)}, span as (select (min(month) || '-01')::date as a, last_day((max(month) || '-01')::date) as b from cal),
weeks as (select unnest(generate_series(date_trunc('week', (select a from span))::timestamp, date_trunc('week', (select b from span))::timestamp, interval 7 day)) as week){ratios},
v as (select date_trunc('week', day::date) as week, sum({value}) as v from dt {join} where day::date between (select a from span) and (select b from span) group by 1)
select strftime(weeks.week, '%Y-%m-%d') as week, floor(coalesce(v, 0) + 0.5)::bigint as value from weeks left join v on weeks.week = v.week"""


@query(_weeks_sql(3, "total::double"))
def timeline_weekly(spark, sf):
    return A.weekly(A.cube(activity(spark, sf)), A.Filters("3m"))


@query(_weeks_sql(3, "n_media::double * coalesce(ratio, 0)", ", tr as (select mt.month, t.n / mt.total::double as ratio from mt join mtopic t on mt.month = t.month and t.topic = 'urgent')", "left join tr on tr.month = dt.day[1:7]"))
def timeline_weekly_filtered(spark, sf):
    return A.weekly(A.cube(activity(spark, sf)), A.Filters("3m", topic="urgent", share_type="media"))


_WEEKS = _weeks_sql(3, "total::double")
_view_query("view_weekly_points", A.Filters("3m"), "points", f"select week as key, strftime(week::date, '%b %d') as label, value from ({_WEEKS})")
_view_query("view_weekly_max", A.Filters("3m", topic="urgent", day=2), "timeline_max", f"select greatest(1, coalesce(max(value), 1))::bigint as timeline_max from ({_WEEKS})")
_view_query("view_weekly_trend", A.Filters("3m"), "trend", f"with r as (select *, row_number() over (order by week) as k, count(*) over () as n from ({_WEEKS})), s as (select sum(value) filter (where k <= n // 2)::bigint as older, sum(value) filter (where k > n // 2)::bigint as recent from r), p as (select *, (recent - older) / older::double * 100.0 as percent from s) select older, recent, percent, case when percent > 8 then 'up' when percent < -12 then 'down' else 'flat' end as direction from p")


@query(f"with {_ACT} select count(*) filter (where kind = 'post') as posts, count(*) filter (where kind = 'comment') as comments, count(*) as total, min(ts) as first, max(ts) as last from act")
def cube_facts(spark, sf):
    return A.cube(activity(spark, sf))["facts"]


@query(f"with {_ACT}, s as (select sum(n) as w from ms) select share_type, sum(n)::bigint as n, sum(n) / max(w)::double as share from ms, s group by share_type")
def donut_shares(spark, sf):
    return A.shares(A.month_share_types(activity(spark, sf)).groupBy("share_type").agg(F.sum("n").alias("n")))


@query(f"""with {_ACT}, {_months(12)}, line as (select month, coalesce(total, 0) as total, coalesce(posts, 0) as posts, coalesce(comments, 0) as comments from cal left join mt using (month)), {_TREND},
kk as (select month, posts, comments, row_number() over (order by month) as k, count(*) over () as n from cal join mt using (month)),
sp as (select month, case when k <= n // 3 then 'from' when k > n - n // 3 then 'to' end as part from kk where n >= 6), sc as (select part, topic, sum(mtopic.n) as n from mtopic join sp using (month) where part is not null group by all),
sb as (select part, topic, row_number() over (partition by part order by n desc, topic) as x from sc), shift as (select max(topic) filter (where part = 'from') as a, max(topic) filter (where part = 'to') as b from sb where x = 1),
rs as (select sum(comments) filter (where k <= n // 2) / nullif(sum(posts) filter (where k <= n // 2), 0)::double as prior, sum(comments) filter (where k > n - n // 2) / nullif(sum(posts) filter (where k > n - n // 2), 0)::double as recent from kk where n >= 6),
dd as (select day::date as d, day::date - (row_number() over (order by day))::int as run from dt semi join cal on dt.day[1:7] = cal.month), ds as (select run, count(*) as n, max(d) as last from dd group by 1), cs as (select arg_max(n, last) as n from ds),
h as (select hour as k, sum(n) as n from mh semi join cal using (month) group by 1), d as (select dow as k, sum(n) as n from mh semi join cal using (month) group by 1),
t as (select topic, sum(mtopic.n) as n from mtopic semi join cal using (month) group by 1 order by n desc, topic limit 1),
f as (select sum(total) as total, sum(comments) / sum(posts)::double as ratio, (sum(total) filter (where k > n // 2) - sum(total) filter (where k <= n // 2)) / (sum(total) filter (where k <= n // 2))::double * 100.0 as pct from r)
select 0::bigint as position, 'steady-pace' as id, 'Steady Rhythm' as title, lpad((select k from h order by n desc, k limit 1)::varchar, 2, '0') || ':00' as value from f where false
union all select row_number() over (order by o) - 1, id, title, value from (
  select 1 as o, case when hh <= 5 then 'early-bird' when hh >= 21 then 'night-owl' else 'steady-pace' end as id, case when hh <= 5 then 'Early Bird' when hh >= 21 then 'Night Owl' else 'Steady Rhythm' end as title, lpad(hh::varchar, 2, '0') || ':00' as value from (select (select k from h order by n desc, k limit 1) as hh)
  union all select 2, case when pct > 8 then 'trending-up' else 'slowing' end, case when pct > 8 then 'Trending Up' else 'Taking a Breather' end, abs(floor(pct + 0.5))::bigint::varchar from f where pct > 8 or pct < -12
  union all select 3, 'topic-shift', 'Focus Shift', a || ' to ' || b from shift where a <> b
  union all select 4, 'engagement-shift', 'Engagement Style Shift', case when recent / prior >= 1.5 then 'more-engaging' else 'more-posting' end from rs where prior > 0 and (recent / prior >= 1.5 or recent / prior <= 0.6)
  union all select 5, 'quiet-stretch', 'Quiet Stretch', total::varchar from f where total < 12
  union all select 6, 'super-engager', case when ratio >= 25 then 'Engagement Machine' when ratio >= 10 then 'Community Builder' else 'Super Engager' end, printf('%.1f', ratio) from f where ratio >= 3
  union all select 7, 'topic-master', 'Topic Focus', topic || ' ' || n from t
  union all select 8, 'streak', case when n >= 100 then 'Unstoppable Streak' when n >= 30 then 'Streak Master' else 'Consistency Streak' end, n::varchar from cs where n >= 7
  union all select 9, 'weekday', 'Peak Day', ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][(select k from d order by n desc, k limit 1) + 1])""")
def insight_cards(spark, sf):
    return _cards(A.view(A.cube(activity(spark, sf)), A.Filters("12m")))


def _cards(v):
    topic = v["topics"].agg(F.max("n").alias("top_count"))
    first = v["topics"].join(topic, F.col("n") == F.col("top_count")).agg(F.min("topic").alias("top_topic"), F.max("top_count").alias("top_count"))
    some = (
        v["trend"].select(F.col("direction").alias("trend_direction"), F.col("percent").alias("trend_percent")),
        v["topic_shift"].select(F.col("from_topic").alias("shift_from"), F.col("to_topic").alias("shift_to")),
        v["ratio_trend"].select(F.col("direction").alias("ratio_direction")),
        v["streaks"].select(F.col("current").alias("current_streak")),
    )
    facts = v["totals"].crossJoin(v["peaks"]).crossJoin(first)
    for one in some:  # a row, or none
        facts = facts.join(one, F.lit(True), "left")
    return insights(facts)


def _cards_sql() -> str:
    """Texts of the cards, from their values."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    value = "case id when 'engagement-shift' then case value " + " ".join(f"when '{k}' then {quoted(v)}" for k, v in SHIFTS.items()) + " end when 'topic-master' then regexp_replace(value, ' (\\d+)$', ' shows up \\1') else value end"
    body = "case id " + " ".join(f"when '{k}' then replace(replace({quoted(t)}, '%s', {value}), '%%', '%')" for k, (_, _, t) in CARDS.items()) + " end"
    note = "case when id = 'super-engager' then case title " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in NOTES.items()) + " end else '' end"
    pick = lambda k: "case id " + " ".join(f"when '{i}' then '{v[k]}'" for i, v in CARDS.items()) + " end"
    return f"select position, id, title, value, {body} || {note} as body, {pick(0)} as icon, {pick(1)} as accent from ({ORACLES['insight_cards']})"


@query(_cards_sql())
def insight_texts(spark, sf):
    return with_texts(insight_cards(spark, sf))


def _connections(spark, sf):
    o, c = _table(spark, sf, "orders"), _table(spark, sf, "customer")
    seen = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("ts"))
    return c.join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("row_idx"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("company"), F.col("c_nationkey").cast("string").alias("position"), "ts")


_CONN = "conn as (select c_custkey as row_idx, c_name as name, c_mktsegment as company, c_nationkey::varchar as position, ts from customer left join (select o_custkey, min(o_orderdate) as ts from orders group by 1) on c_custkey = o_custkey)"


@query(f"""with {_CONN}, m as (select date_trunc('month', ts) as d, count(*) as n from conn where ts is not null group by 1),
cal as (select unnest(generate_series((select min(d) from m)::timestamp, (select max(d) from m)::timestamp, interval 1 month)) as d)
select strftime(cal.d, '%Y-%m') as month, coalesce(n, 0) as n from cal left join m on cal.d = m.d""")
def growth_timeline(spark, sf):
    return P.month_counts(_connections(spark, sf), "ts")


_GROWTH = ORACLES["network_growth"].split("\n", 1)[1]


@query(f"with {_ACT}, {_CONN}, p as (select month, posts as n from mt), c as (select strftime(ts, '%Y-%m') as month, count(*) as n from conn where ts is not null group by 1),\n{_GROWTH}")
def cube_growth(spark, sf):
    """How connections follow posts, from the months of the cube."""
    return A.cube(activity(spark, sf), P.month_counts(_connections(spark, sf), "ts"))["growth"]


@query(ORACLES["growth_timeline"])
def growth_timeline_whole(spark, sf):
    return P.month_counts(_connections(spark, sf), "ts")


@query(f"with {_CONN} select count(*) as total, greatest(0, floor(date_diff('day', min(ts)::date, date '{NOW}') / 30.44::double + 0.5))::bigint as age_months from conn")
def connection_stats(spark, sf):
    return P.connection_stats(_connections(spark, sf), "ts", NOW)


@query(f"with {_CONN} select row_idx, company from conn where ts >= date '{NOW}' - interval 365 day")
def connections_12m(spark, sf):
    return P.in_range(_connections(spark, sf), "ts", "12m", NOW).select("row_idx", "company")


@query(f"with {_CONN} select company as value, count(*) as n, min(row_idx) as first_idx from conn where trim(company) <> '' group by 1 order by n desc, first_idx limit 10")
def top_companies(spark, sf):
    return P.top_values(_connections(spark, sf), "company")


@query(f"with {_CONN} select position as value, count(*) as n, min(row_idx) as first_idx from conn where trim(position) <> '' group by 1 order by n desc, first_idx limit 10")
def top_positions(spark, sf):
    return P.top_values(_connections(spark, sf), "position")


@query(f"with {_CONN} select company as value, count(*) as n from conn group by 1 order by n desc, max(row_idx) limit 1")
def mode_company(spark, sf):
    return P.mode(_connections(spark, sf), "company")


def _people(spark, sf):
    """A participant a row: customers, some with an address; their orders are messages."""
    o = _table(spark, sf, "orders")
    url = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("https://x.test/"), F.col("o_custkey").cast("string"))).otherwise("")
    own = F.when(F.col("o_orderkey") % 2 == 0, url).otherwise("")
    name = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("row_idx"), (F.col("o_orderkey") % 500).cast("string").alias("conv"), F.col("o_orderdate").alias("ts"), name.alias("name"), X.name_key(name).alias("name_key"), own.alias("url"), F.when(F.col("o_orderstatus") == "F", "from").otherwise("to").alias("role"))


_PEOPLE = """ppl as (select o_orderkey as row_idx, (o_orderkey % 500)::varchar as conv, o_orderdate as ts, 'customer ' || o_custkey as name, 'customer ' || o_custkey as name_key,
  case when o_orderkey % 2 = 0 and o_custkey % 3 = 0 then 'https://x.test/' || o_custkey else '' end as url, case when o_orderstatus = 'F' then 'from' else 'to' end as role from orders),
known as (select name_key, arg_max(url, row_idx) as known from ppl where url <> '' group by 1),
ev as (select p.*, case when p.url <> '' then 'url:' || p.url when known is not null then 'url:' || known else 'name:' || p.name_key end as contact from ppl p left join known using (name_key))"""


@query(f"with {_PEOPLE} select contact, count(*) as n, max(ts) as last_ts, arg_max(name, row_idx) as name, arg_min(url, row_idx) as url from ev group by contact")
def contacts(spark, sf):
    return P.contacts(P.canonical_contacts(_people(spark, sf)))


@query(f"""with {_PEOPLE.replace("from orders)", "from orders union all select o_orderkey, (o_orderkey % 500)::varchar, o_orderdate, 'Customer  ' || o_custkey, 'customer ' || o_custkey, '', 'to' from orders)", 1)}
select contact, count(distinct row_idx) as n, max(ts) as last_ts from ev group by contact""")
def contacts_named_twice(spark, sf):
    """Every message names its customer a second time, without the address and in another spelling: it counts once."""
    p = _people(spark, sf)
    again = p.withColumn("name", F.regexp_replace("name", "^customer ", "Customer  ")).withColumn("url", F.lit("")).withColumn("role", F.lit("to"))
    return P.contacts(P.canonical_contacts(p.unionByName(again))).select("contact", "n", "last_ts")


@query(f"with {_PEOPLE}, s as (select date_trunc('month', max(ts)) - interval 11 month as start from ev) select contact, count(*) as n, max(ts) as last_ts from ev, s where ts >= start group by contact order by n desc, last_ts desc, (select arg_max(name, row_idx) from ev e where e.contact = ev.contact), contact limit 10")
def top_contacts(spark, sf):
    return P.top_contacts(P.canonical_contacts(_people(spark, sf)))


@query("""with k as (select c_custkey as row_idx, 'customer ' || c_custkey as name_key, case when c_custkey % 3 = 0 then 'https://x.test/' || c_custkey else '' end as url from customer),
t as (select distinct o_custkey from orders) select row_idx, name_key, url from k where row_idx not in (select o_custkey from t)""")
def silent_connections(spark, sf):
    c = _table(spark, sf, "customer")
    url = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://x.test/"), F.col("c_custkey").cast("string"))).otherwise("")
    conn = c.select(F.col("c_custkey").alias("row_idx"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name_key"), url.alias("url"))
    p = _people(spark, sf)
    return P.silent(conn, p.where("url <> ''").select("url").distinct(), p.select("name_key").distinct()).select("row_idx", "name_key", "url")


@query(f"""with {_PEOPLE}, c as (select contact, max(ts) as last_ts, arg_max(name_key, row_idx) as name_key from ev group by contact),
m as (select contact, last_ts, ck as connection from (select *, substring(name_key, 10)::bigint as ck from c))
select contact, connection, last_ts, floor((epoch(timestamp '{NOW}') - epoch(last_ts)) / 86400)::bigint as days_since from m where connection is not null and floor((epoch(timestamp '{NOW}') - epoch(last_ts)) / 86400) >= 30""")
def fading_conversations(spark, sf):
    conn = _table(spark, sf, "customer").select(F.col("c_custkey").alias("row_idx"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name_key"), F.lit("").alias("url"))
    ev = P.canonical_contacts(_people(spark, sf)).groupBy("contact").agg(F.max("ts").alias("last_ts"), F.max_by("name_key", "row_idx").alias("name_key"), F.lit("").alias("url"))
    return P.fading(P.match_connections(ev, conn), NOW).select("contact", "connection", "last_ts", "days_since")


@query(ORACLES["fading_conversations"])
def fading_conversations_whole(spark, sf):
    return fading_conversations(spark, sf)


def _talk(spark, sf):
    c = _table(spark, sf, "conversations")
    return c.where("role <> 'system'").select(F.col("conv_id").alias("conv"), F.col("turn").alias("ts"), F.col("turn").alias("row_idx"), (F.col("role") == "user").alias("is_self"), "text")


@query("""with m as (select conv_id as conv, turn, role = 'user' as me from conversations where role <> 'system'), c as (select conv, arg_min(me, turn) as s, bool_or(not me) as r from m group by conv)
select count(*) as conversations, count(*) filter (where s) as self_initiated, count(*) filter (where not s) as others_initiated, count(*) filter (where s and r) as replied,
(select count(*) from m where me) as sent, (select count(*) from m where not me) as received, count(*) filter (where s and r) / nullif(count(*) filter (where s), 0)::double as reply_rate,
(select count(*) from m where me) / (select count(*) from m where not me)::double as sent_received_ratio from c""")
def outreach_funnel(spark, sf):
    return P.outreach(_talk(spark, sf))


@query(f"""with {_PEOPLE}, s as (select name_key as key, count(*) as total, count(*) filter (where role = 'from') as sender, count(*) filter (where role = 'to') as recipient, count(distinct conv) as convs, min(row_idx) as first_idx from ppl group by 1)
select * from s""")
def self_stats(spark, sf):
    return P.self_stats(_people(spark, sf), "name_key")


@query(f"""with {_PEOPLE}, s as (select name_key as key, count(*) as total, count(*) filter (where role = 'from') as sender, count(*) filter (where role = 'to') as recipient, count(distinct conv) as convs, min(row_idx) as first_idx from ppl group by 1)
select key as self_key from s order by (sender > 0 and recipient > 0) desc, convs desc, total desc, first_idx, key desc limit 1""")
def self_detect(spark, sf):
    return P.pick_self(P.self_stats(_people(spark, sf), "name_key"))


@query(f"with {_PEOPLE} select name_key, arg_min(url, row_idx) as url from ppl where url <> '' group by 1")
def name_to_url(spark, sf):
    return P.names_to_urls(_people(spark, sf))


@query(f"""with {_PEOPLE}, c as (select conv, array_to_string(list_sort(list_distinct(list(contact))), '|') as thread, max(ts) as last_ts, count(distinct row_idx) as n from ev group by conv)
select thread, count(*) as conversations, sum(n)::bigint as n, max(last_ts) as last_ts from c group by thread""")
def threads(spark, sf):
    return P.threads(P.canonical_contacts(_people(spark, sf)))


@query(f"""with {_PEOPLE.replace("(o_orderkey % 500)::varchar as conv", "o_custkey // 2 || ' ' || year(o_orderdate) as conv", 1)}, c as (select conv as "group", list_sort(list_distinct(list(contact))) as members from ev group by conv)
select "group", min("group") over (partition by members) as thread, len(members)::bigint as size from c""")
def thread_sets(spark, sf):
    """What two customers order in a year is a conversation; most have the people of another year."""
    conv = F.concat_ws(" ", F.floor(F.substring("name_key", 10, 20).cast("long") / 2).cast("string"), F.year("ts").cast("string"))
    return T.thread_sets(P.canonical_contacts(_people(spark, sf).withColumn("conv", conv)))


@query("select conv_id as conv, turn as ts from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations where role <> 'system') where r <= 5")
def thread_tail(spark, sf):
    return P.tail(_talk(spark, sf), "conv", "ts", "row_idx").select("conv", "ts")


def _mail(spark, sf):
    """Messages among customers: each goes to the customer of an order from the clerk the owner is."""
    o = _table(spark, sf, "orders").where("o_custkey is not null")
    url = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("https://x.test/"), F.col("o_custkey").cast("string"))).otherwise("")
    name = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    sent = F.col("o_orderstatus") == "F"
    me, my = F.lit("owner"), F.lit("https://x.test/owner")
    return o.select(
        F.col("o_orderkey").alias("row_idx"), F.when(F.col("o_orderkey") % 10 > 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise("").alias("conv"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.when(sent, me).otherwise(name).alias("sender"), F.when(sent, my).otherwise(url).alias("sender_url"),
        F.array(F.when(sent, name).otherwise(me)).alias("names"), F.filter(F.array(F.when(sent, url).otherwise(my)), lambda x: x != "").alias("urls"), F.lit(False).alias("several"), F.col("o_orderpriority").alias("body"),
    )


@query("""with m as (select o_orderkey as seq, o_orderdate as ts, o_custkey as c, case when o_orderstatus = 'F' then 'sent' else 'received' end as direction, o_orderpriority as body from orders),
t as (select c, case when c % 3 = 0 then 'url:https://x.test/' || c else 'name:customer ' || c end as thread, count(*) as message_count, max(ts) as last_ts from m group by c),
b as (select * from t order by last_ts desc, thread limit 10), r as (select m.*, row_number() over (partition by c order by ts desc, seq desc) as k from m)
select thread, 'customer ' || c as name, case when c % 3 = 0 then 'https://x.test/' || c else '' end as url, message_count, last_ts, seq, ts, direction, body from r join b using (c) where k <= 5""")
def recent_threads(spark, sf):
    return T.recent_threads(_mail(spark, sf), spark.createDataFrame([], "contact_key string"))


@query("""with recursive p as (select o_orderdate as ts, o_custkey as c, o_custkey // 12 || ' ' || strftime(date_trunc('quarter', o_orderdate), '%Y-%m') as thread from orders where o_custkey is not null),
g as (select thread, max(ts) as last_ts, list_distinct(list(c)) as members from p group by 1), t as (select *, row_number() over (order by last_ts desc, thread) as k from g),
f as (select 0::bigint as k, []::bigint[] as seen, false as took union all select t.k, case when len(list_distinct(list_concat(seen, members))) <= 10 then list_distinct(list_concat(seen, members)) else seen end, len(list_distinct(list_concat(seen, members))) <= 10 from f join t on t.k = f.k + 1 where len(seen) < 10)
select thread, len(members)::int as members from f join t using (k) where took""")
def people_budget(spark, sf):
    """A thread is what a circle of twelve customers writes in a quarter, with all its members: a handful at every size, at times more than the budget."""
    ev = P.canonical_contacts(_people(spark, sf))
    circle = F.floor(F.substring("name_key", 10, 20).cast("long") / 12).cast("string")
    thread = F.concat_ws(" ", circle, F.date_format(F.date_trunc("quarter", "ts"), "yyyy-MM"))
    return T.within_budget(ev.groupBy(thread.alias("thread")).agg(F.max("ts").alias("last_ts"), F.array_sort(F.collect_set("contact")).alias("members")), 10)


@query("""with a as (select doc_id, lang, source, n_chars from documents where doc_id % 11 <> 0), b as (select doc_id, lang, source, n_chars + (case when doc_id % 5 = 0 then 1 else 0 end) as n_chars from documents where doc_id % 13 <> 0),
j as (select a.doc_id as x, b.doc_id as y, a.n_chars <> b.n_chars as d from a full join b on a.doc_id = b.doc_id)
select count(*) filter (where d) as rows_differ, count(*) filter (where d) as cells_differ, count(*) filter (where y is null) as only_a, count(*) filter (where x is null) as only_b from j""")
def row_diff(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    changed = d.where("doc_id % 13 <> 0").withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    return P.row_diff(d.where("doc_id % 11 <> 0"), changed, "doc_id", ["lang", "source", "n_chars"])


@query("""with b as (select case when doc_id % 13 = 0 then -1 - doc_id else doc_id end as doc_id, case when doc_id % 7 = 0 then text || ' (edited)' else text end as text, lang, source, n_chars + (case when doc_id % 5 = 0 then 1 else 0 end) as n_chars from documents),
j as (select a.doc_id as x, b.doc_id as y, (a.text is distinct from b.text)::int + (a.lang is distinct from b.lang)::int + (a.source is distinct from b.source)::int + (a.n_chars is distinct from b.n_chars)::int as d from documents a full join b on a.doc_id = b.doc_id)
select count(*) filter (where d > 0 and x is not null and y is not null) as rows_differ, coalesce(sum(d) filter (where x is not null and y is not null), 0)::bigint as cells_differ, count(*) filter (where y is null) as only_a, count(*) filter (where x is null) as only_b from j""")
def row_diff_whole(spark, sf):
    """All documents, all columns, against a version in which some texts and lengths are edited and some rows have another key."""
    d = _table(spark, sf, "documents")
    k = F.col("doc_id")
    changed = d.withColumn("text", F.when(k % 7 == 0, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text"))).withColumn("n_chars", F.col("n_chars") + F.when(k % 5 == 0, 1).otherwise(0))
    changed = changed.withColumn("doc_id", F.when(k % 13 == 0, -1 - k).otherwise(k))
    return P.row_diff(d, changed, "doc_id", ["text", "lang", "source", "n_chars"])


_SIZED = " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "lang", "n_chars", "source", "text"))


_BY_PLACE = """a as (select row_number() over () - 1 as row, doc_id::varchar as c0, lang as c1, n_chars::varchar as c2, text as c3 from documents),
b as (select row_number() over () - 1 as row, doc_id::varchar as c0, case when doc_id % 7 = 0 then null else lang end as c1, (n_chars + (doc_id % 5 = 0)::int)::varchar as c2, text || case when doc_id % 11 = 3 then '!' else '' end as c3 from documents where doc_id <> 5),
j as (select coalesce(a.row, b.row) as row, a.row is not null as x, b.row is not null as y, [a.c0, a.c1, a.c2, a.c3] as a, [b.c0, b.c1, b.c2, b.c3] as b from a full join b on a.row = b.row),
u as (select *, list_filter([0, 1, 2, 3], lambda k: a[k + 1] is distinct from b[k + 1]) as unlike from j)"""


def _by_place(spark, sf):
    d = with_place(_table(spark, sf, "documents"))
    b = d.where("doc_id <> 5").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"), F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("int"), F.concat("text", F.when(F.col("doc_id") % 11 == 3, F.lit("!")).otherwise("")), "_place")
    return P.positional_diff(d.select("doc_id", "lang", "n_chars", "text", "_place"), b, place="_place")


@query(f"with {_BY_PLACE} select count(*) filter (where x and y and len(unlike) > 0) as rows_differ, coalesce(sum(len(unlike)) filter (where x and y), 0)::bigint as cells_differ, count(*) filter (where not y) as only_a, count(*) filter (where not x) as only_b from u")
def row_diff_by_place(spark, sf):
    """Documents against a copy in which a row is missing, so that all after it differ by place."""
    return _by_place(spark, sf)[0]


@query(f"""with {_BY_PLACE}, c as (select row, unnest(unlike)::int as "column", a, b from u where x and y) select row, "column", a["column" + 1] as a, b["column" + 1] as b from c order by row, "column" limit 3""")
def row_diff_places(spark, sf):
    return _by_place(spark, sf)[1]


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 24 hour then 0 else 1 end as new from events where ts is not null),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from s group by user_id, k""")
def user_sessions(spark, sf):
    return SE.sessions(_table(spark, sf, "events"), "user_id")


@query("with s as (select user_id, max(ts) as last_ts from events group by 1), n as (select max(ts) as now from events) select user_id, last_ts, coalesce(last_ts < now - interval 24 hour, true) as stale from s, n")
def stale_users(spark, sf):
    """Who has been silent for more than a session's life when the last event comes."""
    e = _table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("user_id", "last_ts", SE.stale(F.col("last_ts"), F.col("now")).alias("stale"))


@query(f"""with r as (select {_SIZED} as r from documents)
select count(*) as rows, coalesce(sum(('0x' || substr(md5(r), 1, 15))::bigint), 0)::varchar as digest from r""")
def dataset_digest(spark, sf):
    return P.digest(_table(spark, sf, "documents"))


_MISSING_SQL = ", ".join(f"'{m}'" for m in MISSING)
_MESSY = "part_mess as (select p_partkey, case p_partkey % 9 when 0 then '  ' || p_name || ' ' when 1 then 'n/a' when 2 then '=' || p_name when 3 then '\"' || p_name || '\"' when 4 then p_name || ' \\\"said\\\" \"\"it\"\"' when 5 then chr(7) || '-' || p_name when 6 then '\"\"' when 7 then null else p_name end as cell from part)"


def _messy(spark, sf):
    k = F.col("p_partkey") % 9
    n = F.col("p_name")
    cell = F.when(k == 0, F.concat(F.lit("  "), n, F.lit(" "))).when(k == 1, "n/a").when(k == 2, F.concat(F.lit("="), n)).when(k == 3, F.concat(F.lit('"'), n, F.lit('"')))
    cell = cell.when(k == 4, F.concat(n, F.lit(' \\"said\\" ""it""'))).when(k == 5, F.concat(F.lit("\x07-"), n)).when(k == 6, '""').when(k == 7, F.lit(None)).otherwise(n)
    return _table(spark, sf, "part").select("p_partkey", cell.alias("cell"))


_ESC = lambda e: f"(case when regexp_matches({e}, '^[=+\\-@\\t\\r\\n]') then '''' || {e} else {e} end)"
_STRIP = lambda e: f"regexp_replace({e}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"


@query(f"""with {_MESSY}, m as (select *, cell is null or upper(trim(cell)) in ('', {_MISSING_SQL}) as missing from part_mess),
v as (select p_partkey, missing, case when missing then '' else trim(cell) end as value, case when missing then '' else trim(replace(replace(regexp_replace(regexp_replace(cell, '^"', ''), '"$', ''), '"' || chr(10) || '"', chr(10)), '""', '"')) end as commentary,
case when missing then '' else trim(replace(replace(cell, '\\"', '"'), '""', '"')) end as message, case when missing then '' when trim(cell) in ('""', '"') then '' else trim(cell) end as field from m)
select p_partkey, missing, {_ESC(_STRIP('value'))} as value, {_ESC(_STRIP('commentary'))} as commentary, {_ESC(_STRIP('message'))} as message, {_ESC(_STRIP('field'))} as field from v""")
def clean_text(spark, sf):
    c = F.col("cell")
    return _messy(spark, sf).select("p_partkey", X.is_missing(c).alias("missing"), *[X.safe_cell(f(c)).alias(a) for a, f in (("value", X.clean_value), ("commentary", X.clean_commentary), ("message", X.clean_message), ("field", X.clean_empty_field))])


@query("""with t as (select event_id, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 2 then '2024-02-30 10:00:00' when 3 then 'NA' else 'soon' end as d, ts from events)
select event_id, case event_id % 5 when 0 then strftime(date_trunc('second', ts) + interval 1 hour, '%Y-%m-%d %H:%M:%S') when 1 then strftime(date_trunc('second', ts) + interval 1 hour, '%Y-%m-%d %H:%M:%S') when 2 then d when 3 then '' else d end as cleaned,
case when event_id % 5 = 1 then date_trunc('second', ts) end as parsed, case when event_id % 5 = 1 then (isodow(ts) - 1)::int end as dow from t""")
def clean_dates(spark, sf):
    k, iso = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    d = F.when(k == 0, F.concat(iso, F.lit(" UTC"))).when(k == 1, iso).when(k == 2, "2024-02-30 10:00:00").when(k == 3, "NA").otherwise("soon")
    e = _table(spark, sf, "events").select("event_id", d.alias("d"))
    return e.select("event_id", D.clean_utc(F.col("d"), "Africa/Lagos").alias("cleaned"), D.parse_stamp(F.col("d")).alias("parsed"), F.weekday(D.parse_stamp(F.col("d"))).alias("dow"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%d') when 2 then '30 Feb 2026' else '' end as cleaned from orders""")
def clean_connection_dates(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "d MMM yyyy")).when(k == 1, F.date_format("o_orderdate", "dd MMMM yyyy")).when(k == 2, "30 Feb 2026").otherwise("null")
    return _table(spark, sf, "orders").select("o_orderkey", D.clean_long_date(text).alias("cleaned"))


@query("select page_id, lower(rtrim(regexp_extract(coalesce(url, ''), '(?i)https?://[^\\s,;]+'), '/')) as url_key from pages")
def url_normalize(spark, sf):
    return _table(spark, sf, "pages").select("page_id", X.url_key(F.col("url")).alias("url_key"))


@query("select page_id, 2::int as n, lower(rtrim(url, '/')) || '|' || 'https://b.test/x' as keys from pages")
def url_list(spark, sf):
    text = F.concat(F.col("url"), F.lit(", "), F.upper("url"), F.lit("; HTTPS://b.test/x//"))
    p = _table(spark, sf, "pages").select("page_id", X.url_keys(text).alias("k"))
    return p.select("page_id", F.size("k").alias("n"), F.array_join("k", "|").alias("keys"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOPICS = f"""d as (select doc_id, trim(regexp_replace(regexp_replace(text || ' #Tag' || (doc_id % 7) || ' #2024', 'https?://\\S+', '', 'g'), '\\s+', ' ', 'g')) as t from documents),
x as (select doc_id, list_concat(regexp_extract_all(t, '#([A-Za-z0-9_]+)', 1), regexp_extract_all(regexp_replace(t, '#[A-Za-z0-9_]+', ' ', 'g'), '\\b[a-zA-Z]{{3,}}\\b')) as w from d),
y as (select doc_id, list_filter(list_transform(w, lambda z: lower(z)), lambda z, i: z not in ({_STOP}) and list_position(list_transform(w, lambda v: lower(v)), z) = i) as topics from x)"""


def _doc_topics(spark, sf):
    text = F.concat(F.col("text"), F.lit(" #Tag"), (F.col("doc_id") % 7).cast("string"), F.lit(" #2024"))
    return _table(spark, sf, "documents").select("doc_id", X.topics(text).alias("topics"))


@query(f"with {_TOPICS} select doc_id, len(topics)::int as n, list_contains(topics, 'tag3') as tagged, array_to_string(topics, ' ') as topics from y")
def topics_extract(spark, sf):
    return _doc_topics(spark, sf).select("doc_id", F.size("topics").alias("n"), F.array_contains("topics", "tag3").alias("tagged"), F.array_join("topics", " ").alias("topics"))


@query(f"with {_TOPICS}, z as (select unnest(topics) as topic from y) select topic, count(*) as n from z group by 1 order by n desc, topic limit 12")
def topics_top12(spark, sf):
    rows = _doc_topics(spark, sf).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return A.top(rows, "n", ["topic"], 12)


@query("""with s as (select strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders where o_orderstatus = 'F' group by 1) select month, n from s order by n desc, month limit 6""")
def explore_busiest_months(spark, sf):
    return A.top(A.month_totals(activity(spark, sf)).where("posts > 0").select("month", F.col("posts").alias("n")), "n", ["month"], 6)


@query("select source as visibility, count(*) as n, sum(length(text))::bigint // greatest(count(*), 1) as mean_length, 100 * count(*) filter (where lang = 'en') // greatest(count(*), 1) as percent_en from documents group by 1")
def explore_histogram(spark, sf):
    return E.posts_by(_table(spark, sf, "documents").withColumnRenamed("source", "visibility"), "visibility", "text", F.col("lang") == "en").withColumnRenamed("percent", "percent_en")


@query("""with m as (select distinct o_custkey from orders where o_orderstatus = 'F'), r as (select distinct o_custkey from orders where o_orderstatus = 'O') select (select count(*) from m where o_custkey not in (select o_custkey from r)) as ghosts, (select count(*) from r where o_custkey not in (select o_custkey from m)) as fans""")
def explore_ghosts_fans(spark, sf):
    status = F.col("o_orderstatus")
    return E.one_sided(_table(spark, sf, "orders"), "o_custkey", status == "F", status == "O")


@query("with c as (select l_partkey as post, count(*) as n from lineitem group by 1) select sum(n)::bigint as comments, count(*) as posts, max(n) as most from c")
def explore_comments(spark, sf):
    return E.comments_by_post(_table(spark, sf, "lineitem"), "l_partkey")


@query(f"""with {_ACT}, l as (select * from mt where posts > 0 order by month desc limit 6) select month, floor(comments / posts::double * 10 + 0.5) / 10 as ratio from l""")
def explore_comment_ratio(spark, sf):
    return E.comments_per_post(A.month_totals(activity(spark, sf)))


@query("""with c as (select case when c_acctbal >= 0 then 'c' || c_custkey || '@x.test' else ' ' end as email from customer)
select count(*) as rows, count(*) filter (where trim(email) <> '') as visible, 100 * count(*) filter (where trim(email) <> '') // greatest(count(*), 1) as percent from c""")
def explore_emails(spark, sf):
    email = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.test"))).otherwise(" ")
    return E.visible(_table(spark, sf, "customer").select(email.alias("email")), "email")


@query(f"with {_CONN} select strftime(ts, '%Y-%m') as month, count(*) as n from conn where ts is not null group by 1 order by n desc, month limit 5")
def explore_growth_peaks(spark, sf):
    return A.top(P.month_counts(_connections(spark, sf), "ts").where("n > 0"), "n", ["month"], 5)


@query("select coalesce(nullif(case when o_orderkey % 10 = 0 then '' else o_orderpriority end, ''), '?') as value, count(*) as n from orders group by 1")
def explore_folders(spark, sf):
    folder = F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.col("o_orderpriority"))
    return E.histogram(_table(spark, sf, "orders").select(folder.alias("folder")), "folder")


@query("""with c as (select conv_id, arg_min(role = 'user', turn) as mine from conversations group by 1) select count(*) as conversations, count(*) filter (where mine) as initiated from c""")
def explore_initiated(spark, sf):
    """The file is in reverse order of time."""
    c = _table(spark, sf, "conversations")
    return E.initiated(c.select(F.col("conv_id").alias("conv"), (F.col("role") == "user").alias("is_self"), (-F.col("turn")).alias("row_idx")))


@query("""with o as (select 'outbound' as direction, 'customer ' || o_custkey as name, o_orderkey as i from orders where o_orderstatus = 'F' and o_orderkey % 5 <> 0 union all select 'inbound', 'customer ' || o_custkey, o_orderkey from orders where o_orderstatus <> 'F'),
c as (select direction, name, count(*) as n, min(i) as first_idx from o group by all), r as (select *, row_number() over (partition by direction order by n desc, first_idx) as k from c) select direction, name, n, first_idx from r where k <= 6""")
def explore_top_sides(spark, sf):
    """Every fifth message sent goes to two people."""
    name = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    sent = F.col("o_orderstatus") == "F"
    to = F.when(~sent, "owner").when(F.col("o_orderkey") % 5 == 0, F.concat(name, F.lit(", another"))).otherwise(name)
    return E.top_sides(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_idx"), sent.alias("is_self"), F.when(sent, "owner").otherwise(name).alias("sender"), to.alias("recipients")))


@query("select distinct case when s_suppkey % 3 = 0 then 'https://x.test/' || s_suppkey else lower(s_name) end as key from supplier")
def contact_keys(spark, sf):
    s = _table(spark, sf, "supplier")
    url = X.url_key(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("see https://X.test/"), F.col("s_suppkey").cast("string"), F.lit("/"))))
    return s.select(F.coalesce(F.nullif(url, F.lit("")), X.name_key(F.col("s_name"))).alias("key")).distinct()


@query("select '' as file, p_partkey as row_idx, case when length(t) > 50 then t[1:50] || '...' else t end as cell from (select p_partkey, p_name || ' ' || p_type || ' ' || repeat(p_brand, p_size % 9) as t from part order by p_partkey limit 5)")
def preview_rows(spark, sf):
    """The first five parts, long cells cut."""
    p = _table(spark, sf, "part")
    text = F.concat_ws(" ", "p_name", "p_type", F.repeat(F.col("p_brand"), F.col("p_size") % 9))
    return EX.preview(p.select(F.lit("").alias("file"), F.col("p_partkey").alias("row_idx"), text.alias("cell")))


@query("select tag, count(*) as n from (select unnest(list_transform(regexp_extract_all(text || ' #Tag' || (doc_id % 17) || ' ##x #Tag1', '#([0-9A-Za-z_]+)', 1), lambda x: lower(x))) as tag from documents) group by tag order by n desc, tag limit 10")
def explore_hashtags(spark, sf):
    text = F.concat(F.col("text"), F.lit(" #Tag"), (F.col("doc_id") % 17).cast("string"), F.lit(" ##x #Tag1"))
    return E.top_hashtags(_table(spark, sf, "documents").select(text.alias("text")), "text")


@query("select count(*) as rows, count(*) filter (where o_orderpriority = '1-URGENT') as visible, 100 * count(*) filter (where o_orderpriority = '1-URGENT') // greatest(count(*), 1) as percent from orders")
def explore_media(spark, sf):
    """Posts with media, and their percent."""
    return E.visible(_table(spark, sf, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "https://x.test/m").alias("media")), "media")


@query(f"""with {_PEOPLE}, k as (select contact, count(*) as n from ev group by 1), p as (select contact, arg_max(name, row_idx) as name, arg_min(url, row_idx) as url from ev where row_idx % 4 = 0 group by 1)
select contact, n, coalesce(name, 'Unknown') as name, coalesce(url, '') as url from k left join p using (contact)""")
def counts_named(spark, sf):
    """Contacts' messages with the name and address that every fourth row knows them by."""
    ev = P.canonical_contacts(_people(spark, sf))
    return P.with_people(ev.groupBy("contact").agg(F.count(F.lit(1)).alias("n")), P.contacts(ev.where("row_idx % 4 = 0")))


@query("select o_orderkey, case when o_orderkey % 5 > 0 then epoch_ms(date_trunc('day', o_orderdate)) else 0 end::bigint as ms from orders")
def connected_ms(spark, sf):
    o = _table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd MMM yyyy"))
    return o.select("o_orderkey", D.connected_ms(text).alias("ms"))


@query("select p_partkey, case when length(p_name) > 12 then p_name[1:12] || '...' else p_name end as preview from part")
def preview(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", X.truncate(F.col("p_name"), 12).alias("preview"))


@query(ORACLES["preview"])
def preview_whole(spark, sf):
    return preview(spark, sf)


@query("select o_orderkey, case when o_orderkey % 30 = 0 then '-' when o_orderkey % 30 < 12 then (o_orderkey % 30) || ' mo' else printf('%.1f', floor((o_orderkey % 30) / 12.0::double * 10 + 0.5) / 10) || ' yr' end as age, strftime(o_orderdate, '%b %Y') as month_label, strftime(date_trunc('week', o_orderdate), '%b %d') as week_label from orders")
def labels_text(spark, sf):
    o = _table(spark, sf, "orders")
    return o.select("o_orderkey", D.network_age(F.col("o_orderkey") % 30).alias("age"), F.date_format("o_orderdate", "MMM yyyy").alias("month_label"), LB.week_label(F.col("o_orderdate")).alias("week_label"))


def _dated(spark, sf):
    """Orders as messages; every seventh has no time, every tenth names nobody."""
    o = _table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("row_idx"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate")).alias("ts"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("contact"))
    return rows, rows.where("row_idx % 10 > 0 and contact is not null")


_DATED = "m as (select o_orderkey as row_idx, case when o_orderkey % 7 > 0 then o_orderdate end as ts, 'c' || o_custkey as contact from orders)"


@query(f"with {_DATED} select count(*) filter (where ts is null) as undated, count(*) filter (where ts is not null and not named) as nobody, count(*) filter (where ts is null or not named) as skipped from (select *, row_idx % 10 > 0 and contact is not null as named from m)")
def messages_skipped(spark, sf):
    return M.skipped(*_dated(spark, sf))


@query(f"""with {_DATED}, b as (select date_trunc('month', max(ts)) as z from m), cal as (select unnest(generate_series((select z - interval 11 month from b)::timestamp, (select z from b)::timestamp, interval 1 month)) as d),
c as (select date_trunc('month', ts) as d, count(*) as n from m where ts is not null group by 1) select strftime(cal.d, '%Y-%m') as month, coalesce(n, 0) as n from cal left join c on c.d = cal.d""")
def messages_monthly(spark, sf):
    return M.monthly(_dated(spark, sf)[0])


@query(f"""with {_DATED}, s as (select date_trunc('month', max(ts)) - interval 2 month as start from m), r as (select * from m, s where ts >= start)
select count(distinct row_idx) as messages, count(*) as mentions, count(distinct contact) as people from r""")
def messages_in_range(spark, sf):
    return M.range_totals(_dated(spark, sf)[0], "3m")


@query(f"with {_DATED} select arg_max(contact, (n, -f)) as contact from (select contact, count(*) as n, min(row_idx) as f from m where contact is not null group by 1)")
def most_frequent_contact(spark, sf):
    return M.most_frequent(_dated(spark, sf)[0], "contact")


@query("with s as (select o_custkey, bool_or(o_orderstatus = 'F') as sent, bool_or(o_orderstatus <> 'F') as got from orders group by 1) select count(*) filter (where sent and not got) as unanswered_contacts from s")
def unanswered_contacts(spark, sf):
    return M.unanswered(_table(spark, sf, "orders").select(F.col("o_custkey").alias("contact"), (F.col("o_orderstatus") == "F").alias("is_self")))


_FUNNEL = """mail as (select o_orderkey as row_idx, o_orderdate as ts, case when o_orderkey % 10 > 0 then 'c' || o_custkey else 'row-' || o_orderkey end as conv, o_custkey, o_orderstatus = 'F' as me from orders where o_custkey is not null),
cv as (select conv, arg_min(me, (ts, row_idx)) as s, bool_or(not me) as r from mail group by conv), un as (select count(*) as unanswered_contacts from (select o_custkey from mail group by 1 having bool_and(me))),
sd as (select count(*) filter (where me) as sent, count(*) filter (where not me) as received from mail),
funnel as (select count(*) as conversations, count(*) filter (where s) as self_initiated, count(*) filter (where not s) as others_initiated, count(*) filter (where s and r) as replied, count(*) filter (where s and r) / nullif(count(*) filter (where s), 0)::double as reply_rate from cv)"""


@query(f"with {_FUNNEL} select funnel.*, sent, received, sent / nullif(received, 0)::double as sent_received_ratio, unanswered_contacts from funnel, sd, un")
def outreach_of_mail(spark, sf):
    """The whole funnel of a mailbox whose owner is told from it."""
    return R.outreach_of(_mail(spark, sf))


@query(f"""with {_FUNNEL}, f as (select *, sent / nullif(received, 0)::double as ratio from funnel, sd, un)
select 0::bigint as position, 'Outreach initiated' as label, self_initiated::varchar as value from f union all select 1, 'Reply rate', coalesce(floor(reply_rate * 100 + 0.5)::bigint || '%', 'N/A') from f
union all select 2, 'Unanswered', unanswered_contacts::varchar from f union all select 3, 'Sent : received', coalesce(printf('%.1f : 1', ratio), 'N/A') from f""")
def all_time_stats(spark, sf):
    """Without network growth, which months without connections do not show."""
    none = spark.createDataFrame([], "multiplier long, shown boolean")
    return RP.all_time_tiles(none, R.outreach_of(_mail(spark, sf)))


@query("""with c as (select case c_custkey % 5 when 0 then '' when 1 then 'soon' when 2 then '2024-' else '2024-' || lpad((c_custkey % 14)::varchar, 2, '0') || '-01' end as d from customer)
select d[1:7] as month, count(*) as n from c where length(d) > 6 group by 1""")
def connections_as_written(spark, sf):
    """Months 00 and 13 count as they are written."""
    k = F.col("c_custkey")
    d = F.when(k % 5 == 0, "").when(k % 5 == 1, "soon").when(k % 5 == 2, "2024-").otherwise(F.concat(F.lit("2024-"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit("-01")))
    return P.months_as_written(_table(spark, sf, "customer").select(d.alias("d")), "d")


@query(f"""with {_CONN}, r as (select * from conn where ts >= date '{NOW}' - interval 365 day), t as (select company from r group by 1 order by count(*) desc, max(row_idx) limit 1),
a as (select count(*) as total, greatest(0, floor(date_diff('day', min(ts)::date, date '{NOW}') / 30.44::double + 0.5))::bigint as age from conn)
select total, (select count(*) from r) as recent, coalesce((select company from t), '-') as top_company, case when age <= 0 then '-' when age < 12 then age || ' mo' else printf('%.1f', age / 12.0::double) || ' yr' end as network_age from a""")
def connections_view_stats(spark, sf):
    return RP.connections_view(_connections(spark, sf), NOW)["stats"]


@query(f"""with {_CONN}, r as (select * from conn where ts >= date '{NOW}' - interval 365 day) select position as value, count(*) as n, min(row_idx) as first_idx from r where trim(position) <> '' group by 1 order by n desc, first_idx limit 10""")
def connections_view_positions(spark, sf):
    return RP.connections_view(_connections(spark, sf), NOW)["positions"]


@query(f"""with {_ACT}, {_months(12)}, l as (select month from cal left join mt using (month)) select strftime((min(month) || '-01')::date, '%b %Y') || ' to ' || strftime((max(month) || '-01')::date, '%b %Y') as caption from l""")
def report_caption(spark, sf):
    return RP.caption(A.timeline(A.month_totals(activity(spark, sf)), "12m"))


@query(f"""with {_ACT}, {_months(12)}, k as (select mt.* from cal join mt using (month)), hh as (select hour, sum(n) as n from mh join k using (month) group by 1), d as (select distinct day::date as d from dt join k on day[1:7] = k.month),
g as (select d, d - row_number() over (order by d)::int as g from d), s as (select count(*) as n, max(d) as z from g group by g), f as (select sum(posts) as p, sum(comments) as c from k)
select 0::bigint as position, 'Posts' as label, p::varchar as value from f union all select 1, 'Comments', c::varchar from f union all select 2, 'Total activity', (p + c)::varchar from f
union all select 3, 'Peak hour', lpad((select hour from hh order by n desc, hour limit 1)::varchar, 2, '0') || ':00' union all select 4, 'Current streak', (select n from s order by z desc limit 1) || ' days'""")
def activity_stats(spark, sf):
    return RP.activity_tiles(A.view(A.cube(activity(spark, sf)), A.Filters("12m")))


def _report(spark, sf):
    """The whole report, of the last twelve months, all connections and the mailbox, with names."""
    conn, mail = _connections(spark, sf).withColumn("url", F.lit("")).withColumn("name_key", X.name_key(F.col("name"))), stored(_mail(spark, sf))
    tables = A.cube(activity(spark, sf), P.month_counts(conn, "ts"))
    view = A.view(tables, A.Filters("12m"))
    window = RP.caption(view["timeline"], LB.range_label("12m"))
    people = stored(R.people_of(mail))
    ev = stored(R.events_of(mail, people))
    named = conn.withColumn("name", F.concat(F.lit("customer "), F.col("row_idx").cast("string"))).withColumn("name_key", F.col("name"))
    lists = {k: stored(rows) for k, rows in R.panels(mail, named, NOW, events=ev).items()}
    boards = RP.activity_dashboard(view, window), RP.connections_dashboard(RP.connections_view(conn, NOW, "all")), RP.messages_dashboard(mail, ev, conn, lists["fading"], lists)
    peaks = view["totals"].crossJoin(view["peaks"])  # of one row each
    return RP.report_model(*boards, window, _cards(view), RP.post_tip(peaks), RP.all_time_tiles(tables["growth"], R.outreach_of(mail, people, ev)))


_SAY = "list({'label': label, 'value': value} order by position)"
_ITEMS = "list({'label': value, 'value': n} order by n desc, first_idx)"
_CHARTS = "{{'type': '{0}', 'title': {1}, 'points': {2}::STRUCT(label VARCHAR, value BIGINT)[], 'items': {3}::STRUCT(label VARCHAR, value BIGINT)[], 'grid': {4}::BIGINT[][], 'entries': {5}::STRUCT(\"primary\" VARCHAR, \"secondary\" VARCHAR, value VARCHAR)[]}}"


def _chart_sql(kind: str, title: str, **parts: str) -> str:
    return _CHARTS.format(kind, title, *(parts.get(k, "null") for k in ("points", "items", "grid", "entries")))


def _board_sql(title: str, subtitle: str, stats: str, *charts: str) -> str:
    return f"{{'title': '{title}', 'subtitle': {subtitle}, 'stats': {stats}, 'charts': [{', '.join(charts)}]}}"


def _report_sql() -> str:
    """The same document from the SQL of its parts."""
    part = lambda name: f"({ORACLES[name]})"
    conn = f"(with {_CONN} select {{}} as value, count(*) as n, min(row_idx) as first_idx from conn where trim({{}}) <> '' group by 1 order by n desc, first_idx limit 10)"
    ctes = f"""window_ as (select caption from {part("report_caption")}),
points as (select list({{'label': strftime((month || '-01')::date, '%b %Y'), 'value': total}} order by month) as x from {part("timeline_12m")}),
topics as (select list({{'label': topic, 'value': n}} order by n desc, topic) as x from {part("view_topics_top12")}),
hm as (with {_ACT}, {_months(12)} select dow, hour, sum(n)::bigint as n from mh semi join cal using (month) group by all),
grid as (select list(x order by d) as x from (select d, list(coalesce(n, 0)::bigint order by h) as x from range(7) a(d), range(24) b(h) left join hm on dow = d and hour = h group by d)),
act_ as (select {_SAY} as x from {part("activity_stats")}),
line as (select list({{'label': strftime((month || '-01')::date, '%b %Y'), 'value': n}} order by month) as x from {part("growth_timeline")}),
companies as (select {_ITEMS} as x from {conn.format("company", "company")}), positions as (select {_ITEMS} as x from {conn.format("position", "position")}),
cs as (with {_CONN}, a as (select count(*) as total, greatest(0, floor(date_diff('day', min(ts)::date, date '{NOW}') / 30.44::double + 0.5))::bigint as age from conn), t as (select company from conn where trim(company) <> '' group by 1 order by count(*) desc, max(row_idx) limit 1)
  select [{{'label': 'Total connections', 'value': total::varchar}}, {{'label': 'Top company', 'value': coalesce((select company from t), '-')}}, {{'label': 'Network age', 'value': case when age <= 0 then '-' when age < 12 then age || ' mo' else printf('%.1f', age / 12.0::double) || ' yr' end}}] as x from a),
mail as (select o_orderkey as row_idx, o_orderdate as ts, o_custkey as c, 'customer ' || o_custkey as name, case when o_custkey % 3 = 0 then 'https://x.test/' || o_custkey else '' end as url from orders where o_custkey is not null),
mb as (select date_trunc('month', max(ts)) as z from mail), mcal as (select unnest(generate_series((select z - interval 11 month from mb)::timestamp, (select z from mb)::timestamp, interval 1 month)) as d),
mc as (select date_trunc('month', ts) as d, count(*) as n from mail group by 1), mline as (select list({{'label': strftime(mcal.d, '%b %Y'), 'value': coalesce(n, 0)}} order by mcal.d) as x, strftime(min(mcal.d), '%b %Y') || ' to ' || strftime(max(mcal.d), '%b %Y') as caption from mcal left join mc on mc.d = mcal.d),
inr as (select * from mail where ts >= (select z - interval 11 month from mb)), tops as (select name, count(*) as n, max(ts) as last_ts from inr group by name),
top_ as (select list({{'primary': name, 'secondary': 'Last message: ' || strftime(last_ts, '%b %-d, %Y'), 'value': n || ' msgs'}} order by n desc, last_ts desc, name) as x from (select * from tops order by n desc, last_ts desc, name limit 10)),
fade as (select name, max(ts) as last_ts, floor((epoch(timestamp '{NOW}') - epoch(max(ts))) / 86400)::bigint as days from mail group by name having floor((epoch(timestamp '{NOW}') - epoch(max(ts))) / 86400) >= 30),
fade_ as (select count(*) as n, list({{'primary': name, 'secondary': 'Last message: ' || strftime(last_ts, '%b %-d, %Y'), 'value': days || ' days'}} order by last_ts desc, name)[1:10] as x from fade),
quiet as (select 'customer ' || c_custkey as name, c_mktsegment as company, c_nationkey::varchar as position from customer where c_custkey not in (select c from mail)),
quiet_ as (select count(*) as n, list({{'primary': name, 'secondary': position || ' @ ' || company, 'value': 'No date'}} order by name)[1:10] as x from quiet),
ms_ as (select [{{'label': 'Messages in range', 'value': (select count(*) from inr)::varchar}}, {{'label': 'People in range', 'value': (select count(*) from tops)::varchar}}, {{'label': 'Total connections', 'value': (select count(*) from customer)::varchar}}, {{'label': 'Fading conversations', 'value': (select n from fade_)::varchar}}] as x),
cards as (select list({{'id': id, 'title': title, 'body': body, 'icon': icon, 'accent': accent}} order by position) as x from {part("insight_texts")}),
pk as (with {_ACT}, {_months(12)}, x as (select * from mh semi join cal using (month)) select (select hour from x group by hour order by sum(n) desc, hour limit 1)::int as h, (select dow from x group by dow order by sum(n) desc, dow limit 1)::int as d),
grown as (select multiplier from {part("cube_growth")} where shown),
ever as (select list({{'label': label, 'value': value}} order by position) as x from (select -1 as position, 'Network growth' as label, multiplier || '×' as value from grown union all select position, label, value from {part("all_time_stats")}))"""
    title = lambda label, n: f"case when {n} > 10 then '{label} (top 10 of ' || {n} || ')' else '{label}' end"
    activity_ = _board_sql("Analytics", "(select caption from window_)", "(select x from act_)", _chart_sql("line", "'Activity timeline'", points="(select x from points)"), _chart_sql("bar", "'Top topics'", items="(select x from topics)"), _chart_sql("heatmap", "'When you are active'", grid="(select x from grid)"))
    connections_ = _board_sql("Connections", "'All time'", "(select x from cs)", _chart_sql("line", "'Connection growth'", points="(select x from line)"), _chart_sql("bar", "'Top companies'", items="(select x from companies)"), _chart_sql("bar", "'Top positions'", items="(select x from positions)"))
    lists = _chart_sql("list", title("Top contacts", "(select len(x) from top_)"), entries="(select x from top_)"), _chart_sql("list", title("Silent connections", "(select n from quiet_)"), entries="(select coalesce(x, []) from quiet_)"), _chart_sql("list", title("Fading conversations", "(select n from fade_)"), entries="(select coalesce(x, []) from fade_)")
    messages_ = _board_sql("Messages", "'Messages and people: ' || (select caption from mline) || '. Connections, silent and fading: all time.'", "(select x from ms_)", _chart_sql("line", "'Messages per month'", points="(select x from mline)"), *lists)
    tip = "(select 'You are sharpest on ' || ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][d + 1] || ' around ' || lpad(h::varchar, 2, '0') || ':00. I would post then.' from pk)"
    return f"with {ctes} select to_json({{'range_label': (select caption from window_), 'dashboards': [{activity_}, {connections_}, {messages_}], 'insights': (select x from cards), 'tip': {tip}, 'all_time': (select x from ever)}})::varchar as document"


@query("select 'Customers' as label, 'Customers (top 10 of ' || (select count(*) from customer) || ')' as title union all select 'Regions', 'Regions'")
def report_titles(spark, sf):
    return RP.titles({"Customers": _table(spark, sf, "customer"), "Regions": _table(spark, sf, "region")})


@query(_report_sql())
def report_model(spark, sf):
    return RP.as_json(_report(spark, sf))


@query("""with t as (select c_name as name from customer order by c_acctbal desc, c_custkey desc, c_name limit 1), s as (select s_name as name, s_suppkey as d from supplier order by s_suppkey desc, s_name limit 1)
select t.name || ' is your liveliest thread. I would say hello to ' || s.name || ' too, quiet for ' || s.d || ' days now.' as tip from t, s""")
def message_tip(spark, sf):
    top = _table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("n"), F.col("c_custkey").alias("last_ts"))
    fading = _table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("days_since"), F.col("s_suppkey").alias("last_ts"))
    return RP.message_tip(top, _table(spark, sf, "region"), fading)


@query("select doc_id, array_to_string(list_transform(regexp_extract_all(text || ' #Tag' || (doc_id % 7) || ' ##x #Tag1', '#([0-9A-Za-z_]+)', 1), lambda x: lower(x)), ' ') as tags from documents")
def hashtags(spark, sf):
    text = F.concat(F.col("text"), F.lit(" #Tag"), (F.col("doc_id") % 7).cast("string"), F.lit(" ##x #Tag1"))
    return _table(spark, sf, "documents").select("doc_id", F.array_join(X.hashtags(text), " ").alias("tags"))


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'N/A' else floor((o_orderkey % 97) / 96.0::double * 100 + 0.5)::bigint || '%' end as rate, case when o_orderkey % 5 = 0 then 'N/A' else printf('%.1f : 1', (o_orderkey % 97) / 5.0::double) end as ratio from orders""")
def rate_texts(spark, sf):
    k = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 97)
    return _table(spark, sf, "orders").select("o_orderkey", LB.reply_rate(k / 96).alias("rate"), LB.sent_ratio(k / 5).alias("ratio"))
