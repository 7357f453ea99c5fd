"""Export files from bytes to cleaned tables, workbooks and streams."""

import zipfile
from dataclasses import replace
from xml.etree import ElementTree

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tracewell import cli
from tracewell.functions import dates as D
from tracewell.functions import text as X
from tracewell.operators.clean import clean
from tracewell.plans import export
from tracewell.sources import xlsx
from tracewell.sources.export_csv import ExportError, decode, header_of, kind_of, read_export, records, rows_of
from tracewell.sources.specs import SPECS, WEB_LIMITS
from tracewell.streaming.activity import windowed_counts

HEAD = "Date,ShareLink,ShareCommentary,SharedUrl,MediaUrl,Visibility\n"


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokenizer_dialects():
    assert rows_of('a,b\r\n"x,""y""\r\nz",mid"quote\rc,d\n,\n\n') == [["a", "b"], ['x,"y"\nz', 'mid"quote'], ["c", "d"]]
    assert rows_of('"a \\"b\\" ""c"""\n\\,x', "\\") == [['a "b" "c"'], [",x"]]
    for text, escape in (('a,"b', None), ("a\\", "\\")):
        with pytest.raises(ExportError):
            rows_of(text, escape)
    assert header_of(["﻿ Date ", "x"]) == ["Date", "x"]
    with pytest.raises(ExportError, match="Date"):
        header_of(["Date", " Date"])


def test_decoding(spark):
    cases = [(b"caf\xc3\xa9", "café"), (b"caf\xe9", "café"), (b"\x80 \x81 \x93x\x94", "€ \x81 “x”"), (b"\xef\xbb\xbfa", "a"), (bytes(range(0xA0, 0x100)), bytes(range(0xA0, 0x100)).decode("latin-1"))]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    assert [r.t for r in rows.select("i", decode(F.col("b")).alias("t")).orderBy("i").collect()] == [t for _, t in cases]
    latin = rows.where("i = 2").select(decode(F.col("b"), "ISO-8859-1").alias("t")).first().t
    assert latin == "\x80 \x81 \x93x\x94"


@pytest.mark.parametrize(
    "kind, text, rows",
    [
        ("shares", "", None),
        ("shares", ",,\n1,2,3\n", None),
        ("messages", "FROM,TO,DATE\nAda,Bob,2026-01-30 10:00:00 UTC\n", None),
        ("shares", HEAD + '2026-01-30 10:00:00 UTC,https://a.test/s,"Hello, CSV",,,PUBLIC\n', [("2026-01-30 10:00:00", "https://a.test/s", "Hello, CSV", "", "", "PUBLIC")]),
        ("shares", HEAD + "2026-01-30 10:00:00 UTC,https://a.test/s,short\n", [("2026-01-30 10:00:00", "https://a.test/s", "short", "", "", "")]),
        ("shares", HEAD + "2026-01-30 10:00:00 UTC,l,x,,,PUBLIC,more\n", None),
        ("shares", HEAD + '2026-01-30 10:00:00 UTC,l,"open', None),
        ("shares", HEAD + "30 Feb,l,=SUM(1),N/A,\"\",<NA>\nNULL,l,x,,,\n", [("30 Feb", "l", "'=SUM(1)", "", "", "")]),
        ("comments", 'Date,Link,Message\n2026-01-30 10:00:00 UTC,l,"Say \\"hi\\""\n2026-01-30 10:00:00,l,none\n', [("2026-01-30 10:00:00", "l", 'Say "hi"')]),
        ("comments", "Date,Link,Message\n2026-01-30 10:00:00 UTC,l,end\\", None),
        ("connections", "Notes:\nx\n\n", None),
        ("connections", "Notes:\nx\n\nFirst Name,Last Name,URL,Email Address,Company,Position,Connected On\n,,,a@b,c,d,05 Jan 2026\nAda,,u,,-c,@p,5 January 2026\n", [("Ada", "", "u", "", "'-c", "'@p", "2026-01-05")]),
    ],
)
def test_files(spark, tmp_path, kind, text, rows):
    path = tmp_path / "x.csv"
    path.write_text(text)
    if rows is None:
        with pytest.raises(ExportError):
            export.cleaned(spark, str(path), kind)
    else:
        got = export.cleaned(spark, str(path), kind)
        assert [tuple(r) for r in got.orderBy("row_idx").select(*SPECS[kind].names).collect()] == rows
        assert kind_of(text) == kind


def test_limits_and_wrong_kind(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(HEAD + "2026-01-30 10:00:00,l,x,,,\n" * 3)
    for limits in ({"max_rows": 2}, {"max_bytes": 10}):
        with pytest.raises(ExportError, match="more than"):
            read_export(spark, str(path), "shares", **limits)
    assert read_export(spark, str(path), "auto", max_rows=0, max_bytes=0).count() == 3
    with pytest.raises(ExportError, match="looks like a shares"):
        read_export(spark, str(path), "messages")
    with pytest.raises(ValueError):
        read_export(spark, str(path), "shares", max_rows=-1)


def test_dropped_rows_are_observed(spark):
    spec = SPECS["connections"]
    rows = spark.createDataFrame([("A", "", "", "", "", "", "5 Jan 2026"), ("", "N/A", "", "", "", "", "x"), ("B", "", "", "", "", "", "NULL")], ", ".join(f"`{c}` string" for c in spec.names))
    seen = Observation()
    assert clean(rows, spec, seen).count() == 1
    assert seen.get == {"rows": 3, "lacking": 1, "nobody": 1}


def test_text_functions(spark):
    assert values(spark, X.clean_value, [None, " n/a ", "\xa0x﻿", "-1.#IND"]) == ["", "", "x", ""]
    assert values(spark, X.clean_commentary, ['"a"\n"b ""c"""', "NULL"]) == ['a\nb "c"', ""]
    assert values(spark, X.safe_cell, ["\x01=1", "-x", "x\x0b", "\ty"]) == ["'=1", "'-x", "x", "'\ty"]
    assert values(spark, X.url_key, ["see HTTPS://A.b/C//, x", "none", None]) == ["https://a.b/c", "", ""]
    assert values(spark, X.url_keys, ["http://a/ http://A https://b;http://c"]) == [["http://a", "https://b", "http://c"]]
    assert values(spark, X.topics, ["alpha #Beta gamma #beta the https://x.y/zeta", None]) == [["beta", "alpha", "gamma"], []]
    assert values(spark, X.name_key, ["  Ada \xa0 L "]) == ["ada l"]


def test_date_functions(spark):
    assert values(spark, D.clean_utc, ["2026-01-05 10:00:00 utc", "2026-02-30 10:00:00 UTC", "2026-01-05 10:00:00 tail", "None"]) == ["2026-01-05 10:00:00", "2026-02-30 10:00:00", "2026-01-05 10:00:00 tail", ""]
    assert values(spark, lambda c: D.clean_utc(c, "America/New_York"), ["2026-07-05 02:00:00"]) == ["2026-07-04 22:00:00"]
    assert values(spark, D.clean_long_date, ["30 Feb 2026", "1 SEPTEMBER 2025", "01 sep 2025", "x"]) == ["30 Feb 2026", "2025-09-01", "2025-09-01", "x"]
    assert [str(x) for x in values(spark, D.parse_stamp, ["2026-01-05 07", "2026-01-05 07:08", "2026-01-05", "2026-13-05 07"])] == ["2026-01-05 07:00:00", "2026-01-05 07:08:00", "None", "None"]
    assert [str(x) for x in values(spark, D.parse_either, ["2026-01-05 07", "2026-01-05 07:08", " 2026-01-05 "])] == ["None", "2026-01-05 07:08:00", "2026-01-05 00:00:00"]
    assert [str(x) for x in values(spark, D.parse_day, ["2026-02-28", "2026-2-3", "2026-02-30", "0000-01-01", None])] == ["2026-02-28", "None", "None", "None", "None"]


def test_workbook(spark, tmp_path):
    rows = spark.createDataFrame([("a<b", 1, None), ('q"', 2, "x\ny")], "t string, n int, w string")
    out = tmp_path / "deep" / "x.xlsx"
    assert xlsx.write(rows, str(out), "S", wrap=("w",)) == 2
    with zipfile.ZipFile(out) as z:
        assert all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
        texts = "".join(ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).itertext())
    assert texts == 'tnwa<b1q"2x\ny' and [p.name for p in out.parent.iterdir()] == ["x.xlsx"]
    with pytest.raises(Exception):
        xlsx.write(rows.select(F.expr("cast(raise_error('no') as string) as x")), str(out), widths=[10])
    assert [p.name for p in out.parent.iterdir()] == ["x.xlsx"]


def test_command_line_of_all_kinds(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "Shares.csv").write_text(HEAD + "2026-01-30 10:00:00,l,x,,,\n")
    assert cli.main(["all", "--input-dir", str(tmp_path), "--output-dir", str(tmp_path / "o"), "--skip-missing"]) == 0
    assert (tmp_path / "o" / "shares.xlsx").exists() and "shares: 1 rows" in capsys.readouterr().out
    assert cli.main(["comments", "--input-dir", str(tmp_path)]) == 1


def test_stream_counts_are_the_batch_ones(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, by=("event_type",)).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(source, by=("event_type",)).collect()))


def test_limits_of_files(spark, tmp_path):
    text = "Date,Link,Message\n2026-01-05 23:30:00,l,hello\n2026-01-06 10:00:00,l,longer text\n"
    (tmp_path / "c.csv").write_text(text)
    read = lambda **limits: read_export(spark, str(tmp_path / "c.csv"), "comments", **limits).count()
    assert read(max_chars=len(text), max_columns=3, max_field_chars=19, max_rows=2) == 2 and read(**WEB_LIMITS) == 2
    for limits, message in (({"max_chars": len(text) - 1}, "characters"), ({"max_columns": 2}, "columns"), ({"max_field_chars": 18}, "field"), ({"max_rows": 1}, "rows")):
        with pytest.raises(ExportError, match=message):
            read(**limits)
    with pytest.raises(ValueError, match="negative"):
        read(max_columns=-1)


def test_rows_past_a_limit_are_not_read(spark):
    rows = records("Date,Link,Message\na,b,c\nd,e,f\n\"never closed", replace(SPECS["comments"], max_rows=1))
    assert next(rows) == ["a", "b", "c"]
    with pytest.raises(ExportError, match="more than 1 rows"):
        next(rows)


def test_wrong_files_are_named():
    with pytest.raises(ExportError, match="looks like a comments file"):
        next(records("Date,Link,Message\n", SPECS["messages"]))
    with pytest.raises(ExportError, match="does not look like a messages export"):
        next(records("a,b\n", SPECS["messages"]))


def test_times_of_files_are_turned_to_a_zone(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Date,Link,Message\n2026-01-05 23:30:00,l,hello\n")
    at = lambda **zone: export.cleaned(spark, str(tmp_path / "c.csv"), "comments", **zone).first()["Date"]
    assert at() == "2026-01-05 23:30:00" and at(zone="Africa/Lagos") == "2026-01-06 00:30:00"
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert at() == "2026-01-06 08:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "c.csv").write_text("Date,Link,Message\n2026-01-05 23:30:00,l,hello\n")
    args = ["comments", "--input", str(tmp_path / "c.csv"), "--output", str(tmp_path / "out"), "--format", "parquet"]
    assert cli.main([*args, "--time-zone", "Africa/Lagos"]) == 0 and spark.read.parquet(str(tmp_path / "out")).first()["Date"] == "2026-01-06 00:30:00"
    assert cli.main([*args, "--max-input-bytes", "5", "--log-format", "json"]) == 1 and '"level": "ERROR"' in capsys.readouterr().err
    monkeypatch.setenv("TRACEWELL_MAX_INPUT_BYTES", "5")
    assert cli.main(args) == 1 and cli.main([*args, "--max-input-bytes", "0"]) == 0
    monkeypatch.setenv("TRACEWELL_MAX_INPUT_BYTES", "-5")
    assert cli.main(args) == 0 and cli.main([]) == 0
    for wrong in (["--max-rows", "-1"], ["--version"], ["nothing"]):
        with pytest.raises(SystemExit):
            cli.main([*args[:1], *wrong] if wrong[0] != "nothing" else wrong)
    monkeypatch.setattr(cli, "_run", lambda a: (_ for _ in ()).throw(KeyboardInterrupt))
    assert cli.main(args) == 130
    monkeypatch.setattr(cli, "_run", lambda a: 1 // 0)
    assert cli.main(args) == 1
