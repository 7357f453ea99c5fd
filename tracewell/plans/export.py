"""From export files to cleaned tables, activity and workbooks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import dates as D
from tracewell.functions import text as X
from tracewell.operators.clean import clean
from tracewell.sources import xlsx
from tracewell.sources.export_csv import ExportError, read_export
from tracewell.sources.specs import SPECS


@dataclass(frozen=True)
class Result:
    success: bool
    rows: int = 0
    path: str | None = None
    error: str | None = None


def cleaned(spark: SparkSession, path: str, kind: str = "auto", **limits) -> DataFrame:
    rows = read_export(spark, path, kind, **limits)
    found = next(s for s in SPECS.values() if set(s.names) <= set(rows.columns) and len(s.names) == len(rows.columns) - 2)
    return clean(rows, replace(found, zone=limits.get("zone")))


def clean_to_workbook(spark: SparkSession, path: str, out: str, kind: str, **limits) -> Result:
    """Clean one export into a workbook; what goes wrong with the input is in the result."""
    spec = SPECS[kind]
    try:
        rows = cleaned(spark, path, kind, **limits).orderBy("file", "row_idx").select(*[f"`{c}`" for c in spec.names])
        n = xlsx.write(rows, out, kind, wrap=tuple(c.name for c in spec.columns if c.wrap))
    except (ExportError, ValueError) as e:
        return Result(False, path=path, error=str(e))
    return Result(True, n, out)


def clean_to_parquet(spark: SparkSession, path: str, out: str, kind: str, **limits) -> Result:
    """Clean one export, or many, into a folder of Parquet that the executors write; file and row_idx keep the order."""
    try:
        rows = cleaned(spark, path, kind, **limits).select("file", "row_idx", *[f"`{c}`" for c in SPECS[kind].names])
        rows.write.mode("overwrite").parquet(out)
    except (ExportError, ValueError) as e:
        return Result(False, path=path, error=str(e))
    return Result(True, spark.read.parquet(out).count(), out)


#: Rows and characters of a cell that a preview shows.
PREVIEW_ROWS, PREVIEW_CHARS = 5, 50


def preview(rows: DataFrame, n: int = PREVIEW_ROWS, most: int = PREVIEW_CHARS) -> DataFrame:
    """The first rows of a cleaned export (file, row_idx, ...), long cells cut."""
    shown = [c for c in rows.columns if c not in ("file", "row_idx")]
    return rows.orderBy("file", "row_idx").limit(n).select("file", "row_idx", *[X.truncate(F.col(f"`{c}`"), most).alias(c) for c in shown])


def connections_of_file(spark: SparkSession, path: str, **limits) -> DataFrame:
    """Cleaned connections; ExportError where the file has no valid row."""
    rows = cleaned(spark, path, "connections", **limits)
    if rows.isEmpty():
        raise ExportError("the connections file has no valid rows")
    return rows


def activity_of(shares: DataFrame, comments: DataFrame) -> DataFrame:
    """Cleaned shares and comments as an activity table."""
    posts = shares.select(D.parse_stamp(F.col("Date")).alias("ts"), F.lit("post").alias("kind"), X.share_type(F.col("MediaUrl"), F.col("SharedUrl")).alias("share_type"), X.topics(F.col("ShareCommentary")).alias("topics"), "row_idx")
    said = comments.select(D.parse_stamp(F.col("Date")).alias("ts"), F.lit("comment").alias("kind"), F.lit(None).cast("string").alias("share_type"), X.topics(F.col("Message")).alias("topics"), "row_idx")
    return posts.unionByName(said)
