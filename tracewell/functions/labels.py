"""Texts of reports: rates, ratios, months, windows, list titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.constants import RANGE_LABELS, RANGE_MONTHS

#: Rows that a report's list shows.
LIST_LIMIT = 10


def reply_rate(rate: Column) -> Column:
    """A share as whole percent, N/A where there is none."""
    return F.coalesce(F.concat(F.floor(rate * 100 + F.lit(0.5)).cast("long").cast("string"), F.lit("%")), F.lit("N/A"))


def sent_ratio(ratio: Column) -> Column:
    """A ratio to one, with one decimal; N/A where there is none."""
    return F.when(ratio.isNull(), F.lit("N/A")).otherwise(F.format_string("%.1f : 1", ratio.cast("double")))


def month_label(month: Column) -> Column:
    """`2025-01` as `Jan 2025`."""
    return F.date_format(F.concat(month, F.lit("-01")).try_cast("date"), "MMM yyyy")


def week_label(day: Column) -> Column:
    """The Monday of a day's week, as `Jan 05`."""
    return F.date_format(F.date_trunc("week", day), "MMM dd")


def window_caption(first: Column, last: Column) -> Column:
    """The months from first to last; a single month once, nothing where there is none."""
    return F.when(first.isNull() | last.isNull(), F.lit("")).when(first == last, month_label(first)).otherwise(F.concat_ws(" to ", month_label(first), month_label(last)))


def list_title(label: str, total: Column, most: int = LIST_LIMIT) -> Column:
    """The label, with how many there are where the list shows only some."""
    return F.when(total > most, F.format_string(f"{label} (top {most} of %d)", total)).otherwise(F.lit(label))


def range_label(key: str) -> str:
    return RANGE_LABELS.get(key, RANGE_LABELS["12m"])


def range_key(value: object, default: str = "12m") -> str:
    """A range as typed, in any case; the default where it is none."""
    key = str(value or "").lower()
    return key if key == "all" or key in RANGE_MONTHS else default


def limit_of(value: object, default: int) -> int:
    """A whole number of one or more, the part before the point; else the default."""
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return int(number) if 1 <= number < float("inf") else default
