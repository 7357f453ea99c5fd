"""The command line with cleaned tables that Spark writes."""

from tests.test_export import HEAD
from tracewell import cli
from tracewell.sources import xlsx


def test_parquet_has_every_row(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(xlsx, "SHEET_ROWS", 2)
    (tmp_path / "Shares.csv").write_text(HEAD + "".join(f"2026-01-30 10:00:0{i},l{i},x,,,\n" for i in range(5)))
    options = ["shares", "--input-dir", str(tmp_path), "--output-dir", str(tmp_path / "o")]
    assert cli.main(options) == 1  # a sheet is full
    assert cli.main([*options, "--format", "parquet"]) == 0 and "shares: 5 rows" in capsys.readouterr().out
    got = spark.read.parquet(str(tmp_path / "o" / "shares.parquet")).orderBy("file", "row_idx").collect()
    assert [r.ShareLink for r in got] == [f"l{i}" for i in range(5)]
    assert cli.main(["comments", "--input-dir", str(tmp_path), "--format", "parquet"]) == 1
