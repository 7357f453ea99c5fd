"""Dates as text, made from parts so that impossible ones give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.constants import MONTHS
from tracewell.functions.text import is_missing, trim

_STAMP = r"^(\d{4})-(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2})\z"
_LOCAL = r"^(\d{4})-(\d{2})-(\d{2}) (\d{2})(?::(\d{2})(?::(\d{2}))?)?\z"
_MINUTE = r"^(\d{4})-(\d{2})-(\d{2}) (\d{2}):(\d{2})(?::(\d{2}))?\z"
_DAY = r"^\d{4}-\d{2}-\d{2}\z"


#: Where year, month, day, hour, minute and second stand in a text that any of the patterns above fits.
_PLACES = ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))


def _stamp(c: Column, pattern: str) -> Column:
    p = [F.substring(c, at, n).try_cast("int") for at, n in _PLACES]
    zero = F.lit(0)
    return F.when(c.rlike(pattern) & (p[0] >= 1), F.try_make_timestamp_ntz(p[0], p[1], p[2], p[3], F.coalesce(p[4], zero), F.coalesce(p[5], zero)))


def clean_utc(c: Column, zone: str | None = None) -> Column:
    """A UTC time as text in a zone, the session's if none is named; text that is no time stays, without a trailing UTC."""
    bare = trim(F.regexp_replace(trim(c), r"(?i) UTC\z", ""))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone) if zone else F.current_timezone(), _stamp(bare, _STAMP))
    return F.when(is_missing(c), F.lit("")).otherwise(F.coalesce(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), bare))


def clean_long_date(c: Column) -> Column:
    """`5 Jan 2026` or `5 January 2026` as `2026-01-05`; other text stays."""
    text = trim(c)
    pattern = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\z"
    word = F.lower(F.regexp_extract(text, pattern, 2))
    month = F.lit(None).cast("int")
    for k, name in enumerate(MONTHS, 1):
        month = F.when(word.isin(name, name[:3]), F.lit(k)).otherwise(month)
    day = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    year = F.nullif(F.regexp_extract(text, pattern, 3), F.lit("")).cast("int")
    zero = F.lit(0)
    made = F.date_format(F.when(year >= 1, F.try_make_timestamp_ntz(year, month, day, zero, zero, zero)), "yyyy-MM-dd")
    return F.when(is_missing(c), F.lit("")).otherwise(F.coalesce(made, text))


def parse_stamp(c: Column) -> Column:
    """`YYYY-MM-DD HH[:MM[:SS]]` as a time without zone, else null."""
    return _stamp(trim(c), _LOCAL)


def parse_day(c: Column) -> Column:
    """Exactly `YYYY-MM-DD` as a date, else null."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(_DAY) & (F.substring(text, 1, 4) > "0000"), text.try_cast("date"))


def parse_minute(c: Column) -> Column:
    """`YYYY-MM-DD HH:MM[:SS]` as a time without zone, else null."""
    return _stamp(trim(c), _MINUTE)


def parse_either(c: Column) -> Column:
    """A time with minutes, or a day."""
    return F.coalesce(parse_minute(c), parse_day(trim(c)).cast("timestamp_ntz"))


def connected_ms(c: Column) -> Column:
    """Milliseconds since 1970 of exactly `YYYY-MM-DD`; 0 for other text."""
    return F.coalesce(F.unix_date(parse_day(c)).cast("long") * 86_400_000, F.lit(0))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def js_round(c: Column) -> Column:
    """Half towards plus infinity."""
    return F.floor(c + F.lit(0.5)).cast("long")


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than two rows or no variance."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0)))


def days_since(now: Column, ts: Column) -> Column:
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    return F.floor(seconds / 86400).cast("long")


def network_age(months: Column) -> Column:
    return F.when(months <= 0, F.lit("-")).when(months < 12, F.concat(months.cast("string"), F.lit(" mo"))).otherwise(F.concat(F.format_string("%.1f", months / 12.0), F.lit(" yr")))
