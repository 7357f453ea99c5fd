"""Cleaning of export rows: one projection and one filter, in whole-stage code."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracewell.functions.dates import clean_utc
from tracewell.functions.text import is_missing, safe_cell
from tracewell.sources.specs import ExportSpec


def clean(rows: DataFrame, spec: ExportSpec, dropped: Observation | None = None) -> DataFrame:
    """The spec's columns cleaned, in its order, of the rows that have what a row must have. Other columns that
    rows carries (file, row_idx) stay. `dropped` observes how many rows went, without another pass."""
    have = set(rows.columns)
    cleaner = lambda c: partial(clean_utc, zone=spec.zone) if c.cleaner is clean_utc else c.cleaner
    cells = [safe_cell(cleaner(c)(F.col(f"`{c.name}`"))).alias(c.name) if c.name in have else F.lit("").alias(c.name) for c in spec.columns]
    extra = [c for c in rows.columns if c not in spec.names]
    out = rows.select(*extra, *cells)
    lacks = reduce(lambda a, b: a | b, [is_missing(F.col(f"`{c}`")) for c in spec.row_required])
    nobody = reduce(lambda a, b: a & b, [is_missing(F.col(f"`{c}`")) for c in spec.any_of]) if spec.any_of else F.lit(False)
    if dropped is not None:
        out = out.observe(dropped, F.count(F.lit(1)).alias("rows"), F.count_if(lacks).alias("lacking"), F.count_if(~lacks & nobody).alias("nobody"))
    return out.where(~lacks & ~nobody)
