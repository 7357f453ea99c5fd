"""The template tree, walked to the end of its paths, against the SQL at that depth."""

import random
import time

import duckdb

import __spark_entry__ as entry
from tracewell.llm import url_filter


def test_long_paths_and_few_siblings(spark, tmp_path):
    urls = [f"http://a.com/en/x/y/z/v/w/p{i}" for i in range(20)]  # blocked by rule
    urls += [f"http://a.com/fr/x/y/z/v/w/p{i}" for i in range(3)] + ["http://a.com", None, "http://b.com/fr/1"]  # no rule
    urls += [f"http://example.net/de/{d}/k/l/m/{e}/q{i}" for i in range(9) for d, e in (("8x", "n"), ("7x", "o"))]  # both verdicts
    urls += [f"http://example.net/de/{d}/k/l/m/{e}" for d, e in (("8x", "n"), ("7x", "o"))]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in entry.queries()["op8_url_filter_whole"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(con.execute(url_filter.oracle(levels=7)).fetchall())
    by_url = {urls[r[0]]: r for r in got}
    assert by_url["http://a.com/fr/x/y/z/v/w/p1"][3:] == (None, "block", "/*/*/*/*/*/*/*")  # similar to the branch of the rule
    assert by_url["http://b.com/fr/1"][4] == "allow" and not any("**" in r[5] for r in got)
    assert {r[5].split("/")[6] for r in got if r[1] == "example.net" and r[5].count("/") == 7} == {"n", "o"}  # beyond the fourth segment


def test_rounds_do_not_follow_the_depth(spark):
    """Two urls that share 200 segments, a third that leaves them at the 150th, and random trees against the SQL."""
    deep = [f"s{chr(97 + k % 26)}" for k in range(200)]
    paths = ["/".join([*deep, "x"]), "/".join([*deep, "y", "z"]), "/".join([*deep[:150], "other"])]
    rows = spark.createDataFrame([("a.com", "/" + p, 1, 0) for p in paths], "host string, path string, n_block long, n_allow long")
    begin = time.perf_counter()
    got = {r.path.count("/"): r.tpl for r in url_filter.templates(rows).collect()}
    assert time.perf_counter() - begin < 30 and all(t == "/*" * n for n, t in got.items()) and len(got) == 3


def test_random_trees_are_the_sql(spark, tmp_path):
    rng = random.Random(7)
    hosts = ["a.com", "example.com", "b.net", "example.net", "c.org", "d.io"]
    urls = [f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(["en", "de", "es", "p7", "q", "long"]) for _ in range(rng.randint(0, 7))) for _ in range(900)]
    for _ in range(300):  # labels that differ, told by a later segment
        d = rng.choice(["8x", "7x"])
        urls.append("/".join(["http://example.net/de", d, rng.choice("kl"), rng.choice("nm" if d == "8x" else "op"), *rng.choices(["en", "q"], k=rng.randint(0, 3))]))
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in url_filter.judge(spark.read.parquet(str(tmp_path / "pages.parquet"))).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(con.execute(url_filter.oracle(levels=8)).fetchall())
    assert len({x for r in got for x in r[5].split("/")}) > 2
