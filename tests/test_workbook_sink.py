"""The workbook sink: cells, widths, order, and jobs that fail."""

import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tracewell.sources import workbook

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet(path):
    with zipfile.ZipFile(path) as z:
        assert all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
        return ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")), ElementTree.fromstring(z.read("xl/workbook.xml"))


def texts(root):
    return [["".join(c.find("m:f", NS).itertext()) if c.find("m:f", NS) is not None else "".join(c.itertext()) for c in row] for row in root.iter(f"{{{NS['m']}}}row")]


def test_rows_in_order_typed_and_linked(spark, tmp_path):
    workbook.register(spark)
    path = tmp_path / "out.xlsx"
    rows = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("a<&>\n"), F.col("id"))).alias("text"), (F.col("id") % 2 == 0).alias("even"), F.struct(F.lit('https://x.test/"q"').alias("address"), F.lit("a label").alias("label")).alias("link"))
    rows.repartitionByRange(5, "id").sortWithinPartitions("id").write.format("workbook").option("sheet", 'A "sheet"').option("wrap", "text").mode("overwrite").save(str(path))
    root, book = sheet(path)
    assert book.find(".//m:sheet", NS).get("name") == 'A "sheet"' and [float(c.get("width")) for c in root.iter(f"{{{NS['m']}}}col")] == [10, 10, 10, 10]
    found = texts(root)
    assert found[0] == ["id", "text", "even", "link"] and len(found) == 101
    assert found[2] == ["1", "a<&>\n1", "0", 'HYPERLINK("https://x.test/""q""","a label")'] and found[4][1] == ""
    assert [r[0] for r in found[1:]] == [str(k) for k in range(100)]
    assert [p.name for p in tmp_path.iterdir()] == ["out.xlsx"]
    with pytest.raises(Exception, match="FileExists|out.xlsx"):
        rows.write.format("workbook").mode("append").save(str(path))


def test_widths(spark, tmp_path):
    workbook.register(spark)
    path = tmp_path / "w.xlsx"
    spark.createDataFrame([("x" * 20, "y" * 90, "z", None)], "a string, b string, a_name_of_twenty_chars string, d string").write.format("workbook").option("widths", "33").mode("append").save(str(path))
    root, _ = sheet(path)
    assert [float(c.get("width")) for c in root.iter(f"{{{NS['m']}}}col")] == [33, 60, 24, 10]
    spark.createDataFrame([], "a string").write.format("workbook").mode("overwrite").save(str(path))
    assert texts(sheet(path)[0]) == [["a"]]


def test_a_task_that_fails_leaves_no_file(spark, tmp_path, monkeypatch):
    workbook.register(spark)
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 17, F.raise_error(F.lit("killed"))).otherwise("x").cast("string").alias("t"))
    with pytest.raises(Exception):
        bad.write.format("workbook").mode("overwrite").save(str(tmp_path / "bad.xlsx"))
    assert list(tmp_path.iterdir()) == []
