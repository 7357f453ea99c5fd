"""Previews, the rows a report's messages must have, files without rows, what there is to export."""

import pytest
from pyspark.sql import functions as F

from tracewell.plans import export, relationships, report
from tracewell.sources.export_csv import ExportError, read_export

HEAD = "CONVERSATION ID,FROM,TO,DATE,CONTENT,FOLDER,SENDER PROFILE URL,RECIPIENT PROFILE URLS\n"


def test_exported_messages_keep_their_bodies(spark, tmp_path):
    (tmp_path / "m.csv").write_text(HEAD + '1, Ada ,Bob,2026-01-05 10:00:00 UTC,"  =said ""hi""  ",INBOX,https://x/ada,\n2,Ada,Bob,2026-01-06 10:00:00 UTC,n/a,INBOX,,\n3,,Bob,2026-01-06 10:00:00 UTC,x,INBOX,,\n4,-A,Bob,no date,x,INBOX,,\n')
    rows = relationships.exported(read_export(spark, str(tmp_path / "m.csv"), "messages"))
    got = rows.orderBy("row_idx").collect()
    assert [(r.row_idx, r.FROM, r.CONTENT) for r in got] == [(0, "Ada", '  =said "hi"  '), (3, "-A", "x")]
    assert [r.body for r in relationships.messages_of(rows).collect()] == ['  =said "hi"  ']


def test_preview_and_files_without_rows(spark, tmp_path):
    head = "Notes:\nx\n\nFirst Name,Last Name,URL,Email Address,Company,Position,Connected On\n"
    (tmp_path / "c.csv").write_text(head + "".join(f"Ada {k},,u{k},,{'c' * (49 + k)},,05 Jan 2026\n" for k in range(7)))
    shown = export.preview(export.connections_of_file(spark, str(tmp_path / "c.csv"))).orderBy("row_idx").collect()
    assert [r.Company for r in shown] == ["c" * 49, "c" * 50, *["c" * 50 + "..."] * 3] and shown[0]["Connected On"] == "2026-01-05"
    (tmp_path / "none.csv").write_text(head + ",,,,,,05 Jan 2026\n")
    with pytest.raises(ExportError, match="no valid rows"):
        export.connections_of_file(spark, str(tmp_path / "none.csv"))


def test_exportable(spark):
    none, one = spark.createDataFrame([], "a int"), spark.createDataFrame([(1,)], "a int")
    growth = one.select(F.lit(False).alias("shown"))
    assert not report.exportable() and not report.exportable(none, growth, none, none)
    assert report.exportable(one) and report.exportable(None, None, one)
    assert report.exportable(none, growth.select(F.lit(True).alias("shown"))) and report.exportable(none, growth, none, none, one)
