"""URL filters by a path-template tree, in DataFrame functions only.

Explicit rules come first: a rule (host, path) fits its host and every subdomain where the
url's path starts with the rule's path, and the longest rule wins. What they say is also what
the tree learns from. Per host the paths are walked level by level, to their ends. A segment that
holds a digit is a variable at once. Siblings, the children of one branch, are merged where their
shares of blocked labels are statistically alike: a child stands out if it has `support` labelled
urls and its smoothed share is away from the branch's by more than `z` standard errors; those that
do not are one wildcard `*`. Children that stand out to one side are held against each other: those
alike their side's common share are one wildcard as well (`*+` above, `*-` below), and one that is
not, or is alone on its side, keeps its name. A template whose smoothed share of blocked labels
is `purity` or more, with `support` labels, is rejected.

Only counts by (host, template, segment) are grouped and joined, and they are broadcast up to a
number of rows and salted beyond, so a host with a third of all urls is pre-aggregated before each
shuffle and its urls are never gathered in one task. A round reads only the paths that go on. An only
child never differs from its branch, so the segments that all paths of a branch share are wildcards and
taken in one step; a branch that holds one path is finished by it. Every round, a row a distinct
path, is checkpointed, which keeps plans short; there are as many as a path has places where its branch
divides, whatever its length. Urls meet their path's verdict by join_small as well, so that a url that
occurs very often is no hot key.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is
allowed unless its (empty) template is rejected. Repeated rows are judged alike and each counts. A
very long url is one row of text, walked like others. Ties at exactly `z` standard errors are alike.
An empty table gives no rows; columns besides page_id and url are ignored, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import BROADCAST_ROWS, cut, join_small

#: Fixed values of the query: host, path prefix, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
SUPPORT = 5
Z = 3.0
PURITY = 0.9
PRIOR = 2.0


def parts(url: Column) -> tuple[Column, Column]:
    """host and path of a url."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def by_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _away(b: str, n: str, of_b: str, of_n: str, z: float) -> Column:
    """By how many standard errors beyond z a share b / n, drawn to the share of_b / of_n, is away from it; positive where it is."""
    mean = (F.col(of_b) + 0.5) / (F.col(of_n) + 1.0)
    return F.abs((F.col(b) + mean) / (F.col(n) + 1.0) - mean) - z * F.sqrt(mean * (1 - mean) / (F.col(n) + 1.0))


def _names(kids: DataFrame, few: bool, support: int, z: float) -> DataFrame:
    """host, tpl, _seg and _name, what a child is called in templates; kids has _b blocked of _l labelled urls."""
    at, kept = ["host", "tpl"], (lambda df: df) if few else cut
    branch = kept(kids.groupBy(*at).agg(F.sum("_b").alias("_pb"), F.sum("_l").alias("_pl")))
    kids = join_small(kids, branch, at, few=few)
    above = F.col("_b") * (F.col("_pl") + 1.0) > (F.col("_pb") + 0.5) * F.col("_l")
    out = (F.col("_l") >= support) & (_away("_b", "_l", "_pb", "_pl", z) > 0)
    kids = kept(kids.withColumn("_side", F.when(out & above, "*+").when(out, "*-").otherwise("*")))
    sides = kept(kids.where("_side <> '*'").groupBy(*at, "_side").agg(F.sum("_b").alias("_sb"), F.sum("_l").alias("_sl"), F.count(F.lit(1)).alias("_n")))
    kids = join_small(kids, sides, [*at, "_side"], "left", few=few)
    alone = (F.col("_side") != "*") & ((F.col("_n") == 1) | (_away("_b", "_l", "_sb", "_sl", z) > 0))
    return kept(kids.select(*at, "_seg", F.when(alone, F.col("_seg")).otherwise(F.col("_side")).alias("_name")))


def templates(paths: DataFrame, support: int = SUPPORT, z: float = Z) -> DataFrame:
    """host, path, n_block, n_allow -> and tpl, the path's template.

    A round first takes the segments that all paths of a branch go on with, in one step: the longest common beginning
    of its first and its last path in order. Then it names the children of what is left."""
    variable = F.transform(F.split(F.regexp_replace("path", "^/", ""), "/"), lambda x: F.when(x.rlike("[0-9]"), F.lit("*")).otherwise(x))
    rows = paths.withColumn("_segs", variable).withColumn("tpl", F.lit("")).withColumn("_at", F.lit(0))
    keep, branch, at, done = [*paths.columns, "tpl"], ["host", "tpl"], ["host", "tpl", "_seg"], []
    ended = F.col("_at") >= F.size("_segs")
    while True:
        rest = F.slice("_segs", F.col("_at") + 1, F.size("_segs"))
        runs = rows.groupBy(*branch).agg(F.min(rest).alias("_lo"), F.max(rest).alias("_hi"))
        differ = F.array_position(F.zip_with("_lo", "_hi", lambda x, y: F.coalesce(x != y, F.lit(True))), True)
        runs = cut(runs.select(*branch, F.when(differ > 0, differ - 1).otherwise(F.size("_lo")).cast("int").alias("_run")))
        n = runs.count()
        if not n:
            return functools.reduce(DataFrame.union, done, paths.withColumn("tpl", F.lit("")).where(F.lit(False)))
        rows = join_small(rows, runs, branch, few=n <= BROADCAST_ROWS)
        rows = cut(rows.withColumn("tpl", F.concat("tpl", F.repeat(F.lit("/*"), F.col("_run")))).withColumn("_at", F.col("_at") + F.col("_run")).drop("_run"))
        done.append(rows.where(ended).select(*keep))
        rows = rows.where(~ended).withColumn("_seg", F.get("_segs", F.col("_at")))
        kids = cut(rows.groupBy(*at).agg(F.sum("n_block").alias("_b"), F.sum(F.col("n_block") + F.col("n_allow")).alias("_l")))
        n = kids.count()  # of this round; branches and sides are fewer
        named = join_small(rows, _names(kids, n <= BROADCAST_ROWS, support, z), at, few=n <= BROADCAST_ROWS)
        rows = cut(named.withColumn("tpl", F.concat("tpl", F.lit("/"), "_name")).withColumn("_at", F.col("_at") + 1).drop("_seg", "_name"))
        done.append(rows.where(ended).select(*keep))
        rows = rows.where(~ended)


def judge(pages: DataFrame, rules=RULES, purity: float = PURITY, prior: float = PRIOR, support: int = SUPPORT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict and template for every row of pages."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", by_rule(F.col("host"), F.col("path"), rules).alias("_rule"))
    counted = rows.groupBy("host", "path").agg(F.count_if(F.col("_rule.verdict") == "block").alias("n_block"), F.count_if(F.col("_rule.verdict") == "allow").alias("n_allow"))
    named = cut(templates(cut(counted), support, z))
    few = named.count() <= BROADCAST_ROWS  # distinct paths; templates are fewer
    pure = named.groupBy("host", "tpl").agg(F.sum("n_block").alias("_b"), F.sum("n_allow").alias("_a"))
    bad = (F.col("_b") + F.col("_a") >= support) & ((F.col("_b") + 0.5 * prior) / (F.col("_b") + F.col("_a") + prior) >= purity)
    pure = pure.select("host", "tpl", F.when(bad, F.lit("block")).otherwise(F.lit("allow")).alias("_method"))
    named = join_small(named.select("host", "path", "tpl"), pure if few else cut(pure), ["host", "tpl"], few=few)
    out = join_small(rows, named if few else cut(named), ["host", "path"], few=few)
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.col("_method")).alias("verdict"), F.col("tpl").alias("template"))


def oracle(levels: int = 6, rules=RULES, support: int = SUPPORT, z: float = Z, purity: float = PURITY, prior: float = PRIOR) -> str:
    """The same in DuckDB SQL, over the view pages; SQL needs the number of segments of the longest path ahead, and fails on longer ones."""
    fit = lambda r: f"((host = '{r[0]}' or suffix(host, '.{r[0]}')) and starts_with(path, '{r[1]}'))"
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    case = lambda k: "case " + " ".join(f"when {fit(r)} then '{r[0] + r[1] if k == 'rule' else r[2]}'" for r in longest) + " end"
    away = lambda b, n, mean: f"abs(({b} + {mean}) / ({n} + 1.0::double) - {mean}) - {z}::double * sqrt({mean} * (1 - {mean}) / ({n} + 1.0::double)) > 0"
    sql = f"""with cutup as (select page_id, case when contains(url, '://') then substring(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cutup),
ruled as (select page_id, host, path, {case('rule')} as rule, {case('verdict')} as rv from split),
t0 as (select host, path, count(*) filter (where rv = 'block') as nb, count(*) filter (where rv = 'allow') as na, '' as tpl, string_split(regexp_replace(path, '^/', ''), '/') as segs from ruled group by host, path)"""
    for k in range(levels):
        sql += f""",
s{k} as (select *, case when regexp_matches(segs[{k + 1}], '[0-9]') then '*' else segs[{k + 1}] end as seg from t{k}),
k{k} as (select host, tpl, seg, sum(nb) as b, sum(nb + na) as l from s{k} where seg is not null group by host, tpl, seg),
p{k} as (select *, (sum(b) over w + 0.5::double) / (sum(l) over w + 1.0::double) as mean, b * (sum(l) over w + 1.0::double) > (sum(b) over w + 0.5::double) * l as above from k{k} window w as (partition by host, tpl)),
o{k} as (select *, case when l >= {support} and {away('b', 'l', 'mean')} then case when above then '*+' else '*-' end else '*' end as side from p{k}),
n{k} as (select host, tpl, seg, case when side <> '*' and (m = 1 or {away('b', 'l', 'smean')}) then seg else side end as name from (select *, count(*) over w as m, (sum(b) over w + 0.5::double) / (sum(l) over w + 1.0::double) as smean from o{k} window w as (partition by host, tpl, side))),
t{k + 1} as (select s.host, s.path, s.nb, s.na, s.tpl || case when s.seg is null then '' else '/' || n.name end as tpl, s.segs from s{k} s left join n{k} n on s.host = n.host and s.tpl = n.tpl and s.seg = n.seg)"""
    return sql + f""",
named as (select host, path, nb, na, case when len(segs) > {levels} then error('a path has more than {levels} segments') else tpl end as tpl from t{levels}),
pure as (select host, tpl, case when sum(nb) + sum(na) >= {support} and (sum(nb) + {0.5 * prior}::double) / (sum(nb) + sum(na) + {prior}::double) >= {purity}::double then 'block' else 'allow' end as method from named group by host, tpl)
select r.page_id, r.host, r.path, r.rule, coalesce(r.rv, p.method) as verdict, n.tpl as template
from ruled r left join named n on r.host = n.host and r.path = n.path left join pure p on n.host = p.host and n.tpl = p.tpl"""
