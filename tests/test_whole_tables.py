"""Registered queries that take every row of their tables."""

import random
from datetime import datetime
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pandas as pd
import pytest

from tests.sql_compare import _rows
from tracewell import queries
from tracewell.operators.ordinal import in_file_order, with_place
from tracewell.operators.stored import ensure_checkpoint_dir

DATA = "/root/testdata/sf0.001"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))


def test_all_rows_count(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    run = lambda q: queries.QUERIES[q](spark, DATA)
    assert run("preview_whole").count() == read("part").count()
    buyers = read("customer").join(read("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_semi").count()
    assert run("growth_timeline_whole").agg({"n": "sum"}).first()[0] == buyers
    assert {r.connection % 4 for r in run("fading_conversations_whole").collect()} == {0, 1, 2, 3}


def test_growth_of_whole_tables(spark, tmp_path):
    months = [datetime(2000 + m // 12, m % 12 + 1, 5) for m in range(14)]
    n = [(1, 1), (9, 6)]  # orders and lines of a quiet and of a busy month, none in the slice
    orders = [(40 * i + 1, d) for k, d in enumerate(months) for i in range(n[k % 2][0])]
    lines = [(50 * i + 1, d) for k, d in enumerate(months) for i in range(n[k % 2][1])]
    write(spark, tmp_path, "orders", orders, "o_custkey long, o_orderdate timestamp_ntz")
    write(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_shipdate timestamp_ntz")
    got = queries.QUERIES["network_growth_whole"](spark, str(tmp_path)).first()
    # the ten busiest months are the seven busy ones and three quiet ones: (7 * 6 + 3 * 1) / 10 = 4.5
    assert (got.months, got["corr"], got.quiet_avg, got.top_avg, got.multiplier, got.shown) == (14, 1.0, 1, 5, 5, True)


@pytest.mark.parametrize("ids, expected", [((1,), (0, 0, 0, 0)), ((7,), (1, 1, 0, 0)), ((35,), (1, 2, 0, 0)), ((0, 11, 13, 14), (1, 1, 2, 2))])
def test_row_diff_sees_texts_and_every_row(spark, tmp_path, ids, expected):
    write(spark, tmp_path, "documents", [(i, f"text {i}", "en", None, 6) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    assert tuple(queries.QUERIES["row_diff_whole"](spark, str(tmp_path)).first()) == expected


def in_files(spark, folder, sizes):
    """documents as files of these many rows, each longer text by text, so that Spark deals later files first."""
    at = 0
    for k, n in enumerate(sizes):
        rows = [(at + i, f"text {at + i} " * (1 + 40 * k), "en", None, 6) for i in range(n)]
        made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        made.toPandas().to_parquet(folder / f"part-{k:04d}.parquet", index=False)
        at += n
    return at


@pytest.mark.parametrize("name", ["row_diff_by_place", "row_diff_places"])
def test_rows_by_place_of_several_files(spark, tmp_path, name):
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    in_files(spark, folder, (3, 9, 27, 40))
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/*.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert _rows(map(tuple, got.collect()), got.columns) == _rows(found.fetchall(), columns)


@pytest.mark.parametrize("name", ["row_diff_by_place", "row_diff_places"])
@pytest.mark.parametrize("files, first", [(("p 0", "p!1", "p#2", "p+3", "p{4}", "p~5", "pé6"), 0), (("p{0", "pz1", "p|2"), 0), (("p0", "p1"), -40)])
def test_rows_by_place_of_any_name_and_key(spark, tmp_path, name, files, first):
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    for k, f in enumerate(files):
        ids = range(first + 30 * k, first + 30 * k + 30)
        pd.DataFrame({"doc_id": ids, "text": [f"text {i}" for i in ids], "lang": "en", "source": None, "n_chars": 6}).to_parquet(folder / f"{f}.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert got.columns == [c[0] for c in con.execute(queries.ORACLES[name]).description]
    assert list(map(tuple, got.collect())) == con.execute(queries.ORACLES[name]).fetchall()


def test_rows_by_place_store_no_long_texts(spark, tmp_path):
    made = random.Random(5)
    texts = [made.randbytes(20_000).hex() for _ in range(60)]
    write(spark, tmp_path, "documents", [(i, t, "en", None, 6) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stored_bytes = lambda: sum(f.stat().st_size for f in Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path).rglob("*") if f.is_file())
    ensure_checkpoint_dir(spark)
    before = stored_bytes()
    counts = queries.QUERIES["row_diff_by_place"](spark, str(tmp_path)).first()
    assert (counts.rows_differ, counts.only_a) == (56, 1)  # rows 5 to 58, and 0 and 3
    assert stored_bytes() - before < sum(map(len, texts)) / 20
    third = queries.QUERIES["row_diff_places"](spark, str(tmp_path)).orderBy("row", "column").collect()[2]
    assert (third.row, third.column, third.a, third.b) == (3, 3, texts[3], texts[3] + "!")


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_places_in_file_order(spark, tmp_path, block):
    total = in_files(spark, tmp_path, (3, 9, 27))
    rows = in_file_order(with_place(spark.read.parquet(str(tmp_path))).where("doc_id % 4 <> 1"), block=block)
    assert "_place" not in rows.columns
    assert [r.doc_id for r in rows.orderBy("ordinal").collect()] == [k for k in range(total) if k % 4 != 1]
    assert sorted(r.ordinal for r in rows.collect()) == list(range(sum(k % 4 != 1 for k in range(total))))
