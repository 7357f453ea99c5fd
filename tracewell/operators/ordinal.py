"""Places of rows in a whole table, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.stored import stored

#: monotonically_increasing_id() holds the partition above this bit, the place in it below.
_PLACE_BITS = 33


def numbered(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """df, stored, with the place of each row from 0 in the order in which its partitions hold them."""
    rows = stored(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)).drop("_part", "_before", "_at")


#: Rows of a file that are ranked together; sums before them run over such blocks.
FILE_BLOCK = 4096


def with_place(df: DataFrame, name: str = "_place") -> DataFrame:
    """A table as `read.parquet` gives it, with the file and the place in it of each row. Partitions do not show that
    order: Spark deals files by their sizes, several to a task."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))


def in_file_order(df: DataFrame, place: str = "_place", name: str = "ordinal", block: int = FILE_BLOCK) -> DataFrame:
    """df, without place, with the place of each row from 0 in the order of file names and of rows in a file; rows may have been left out."""
    rows = df.withColumn("_file", F.col(f"{place}.file")).withColumn("_block", F.floor(F.col(f"{place}.row") / block))
    sizes = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))  # one row a block
    called = F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B")))  # the path's characters, which Spark gives escaped
    before = F.coalesce(F.sum("_n").over(W.orderBy(called, "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", "_block", before.alias("_before"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_file", "_block").orderBy(f"{place}.row")) - 1)
    out = ranked.join(F.broadcast(starts), ["_file", "_block"])
    return out.withColumn(name, F.col("_before") + F.col("_r")).drop("_file", "_block", "_before", "_r", place)


def ordinal(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """df, stored, with the place of each row from 0 in this order over the whole table.

    Partitions are ranges of the order; rows that tie are dealt at random, so a key with many rows
    alike is spread as well. Prefix sums run over the sizes of partitions only.
    """
    rows = df.withColumn("_tie", F.rand(17))
    rows = rows.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    return numbered(rows.drop("_tie"), name)
