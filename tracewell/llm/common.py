"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.stored import ensure_checkpoint_dir
from tracewell.operators.stored import stored as cut  # noqa: F401

BROADCAST_ROWS = 200_000
SALTS = 16
SMALL_BYTES = 32 << 20
#: Fixed value: what separates words everywhere in this package.
SPLIT = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores where it is a small table, which lies in one or two row groups and would be one task; others as they are."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")


def crc_rest(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def whole(df: DataFrame) -> Column:
    """All columns of df as one struct, so that its names cannot clash with ours; select("name.*") gives them back."""
    return F.struct(*[column(c) for c in df.columns])


def column(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's values in all columns; those that Spark does not hash go as JSON."""
    plain = [F.to_json(F.struct(column(f.name))) if re.search("map<|variant", f.dataType.simpleString()) else column(f.name) for f in df.schema.fields]
    return F.xxhash64(*plain)


#: The columns by which row_key names a row.
ROW_KEY = ["_r1", "_r2", "_r3"]


def row_key(docs: DataFrame) -> list[Column]:
    """Three hashes that name a row by its doc_id and text, its text, and all its columns; rows alike in all of them are the same."""
    text = F.coalesce(column("text"), F.lit(""))
    return [F.xxhash64(column("doc_id"), text).alias("_r1"), F.xxhash64(text, F.lit(1)).alias("_r2"), row_hash(docs).alias("_r3")]


def join_small(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = BROADCAST_ROWS, salts: int = SALTS, few: bool | None = None) -> DataFrame:
    """rows joined (inner, left or left_semi) with a stored frame of one short row a key.

    Up to `most` rows are broadcast (`few`, where the caller has counted them already). Beyond, the rows of a key are dealt over `salts` tasks, each of which gets
    a copy of the key's row, and Spark's adaptive execution splits what is still too large.
    """
    if small.count() <= most if few is None else few:
        return rows.join(F.broadcast(small), keys, how)
    dealt = rows.withColumn("_salt", F.floor(F.rand(3) * salts).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def one_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """_doc (all columns of docs) and wanted's columns, once for each row key of wanted, which is stored and has _same, the number of rows alike.

    A text moves only where `wanted` is too large to broadcast, or where rows are repeated.
    """
    rows = docs.select(whole(docs).alias("_doc"), *row_key(docs))
    once, more = wanted.where("_same = 1"), wanted.where("_same > 1")
    found = join_small(rows, once, ROW_KEY)
    if more.isEmpty():
        return found
    return found.unionByName(join_small(rows, more, ROW_KEY).dropDuplicates(ROW_KEY))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_dir named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that workers find it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_tracewell_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp()) / "tracewell.zip"  # the driver's own copy; Spark serves it
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(file))
    sc._tracewell_shipped = True
