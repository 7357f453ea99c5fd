"""Cleaning and normalising text columns; every function maps Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.constants import MISSING, STOP_WORDS

#: White space as scripts trim it: Unicode spaces and the byte order mark.
_EDGE = r"(?U)^[\s﻿]+|[\s﻿]+\z"


def trim(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), _EDGE, "")


def is_missing(c: Column) -> Column:
    """Null, blank, or one of the words that stand for a missing value."""
    return F.upper(trim(c)).isin("", *MISSING)


def _cleaned(c: Column, value: Column) -> Column:
    return F.when(is_missing(c), F.lit("")).otherwise(value)


def clean_value(c: Column) -> Column:
    return _cleaned(c, trim(c))


def clean_commentary(c: Column) -> Column:
    """Outer quotes off, quotes about line breaks off, doubled quotes single."""
    bare = F.regexp_replace(F.regexp_replace(c, r'^"', ""), r'"\z', "")
    return _cleaned(c, trim(F.replace(F.replace(bare, F.lit('"\n"'), F.lit("\n")), F.lit('""'), F.lit('"'))))


def clean_message(c: Column) -> Column:
    """Backslashed, then doubled quotes single."""
    return _cleaned(c, trim(F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit('""'), F.lit('"'))))


def clean_empty_field(c: Column) -> Column:
    return _cleaned(c, F.when(trim(c).isin('""', '"'), F.lit("")).otherwise(trim(c)))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def escape_formula(c: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), c)).otherwise(c)


def safe_cell(c: Column) -> Column:
    return escape_formula(strip_controls(c))


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim(c)), r"(?U)\s+", " ")


def url_key(c: Column) -> Column:
    """The first web address in the text, lower-cased, without trailing slashes."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)https?://[^\s,;]+", 0), r"/+\z", ""))


def url_keys(c: Column) -> Column:
    """All web addresses in the text, normalised, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)https?://[^\s,;]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"/+\z", ""))))


def recipient_names(names: Column, urls: Column) -> Column:
    """One name where there is at most one address, else the names between commas."""
    whole = trim(names)
    parts = F.filter(F.transform(F.split(whole, ","), trim), lambda x: x != "")
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(url_keys(urls)) <= 1, F.array(whole)).otherwise(parts)


def several_recipients(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: trim(x) != "")) > 1


def contact_key(url: Column, name: Column) -> Column:
    return F.when(url != "", F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("name:"), F.when(name == "", F.lit("unknown")).otherwise(name)))


def plain_text(c: Column) -> Column:
    """Without web addresses, white space collapsed."""
    return trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"https?://\S+", ""), r"(?U)\s+", " "))


def topics(c: Column) -> Column:
    """Hashtags, then words of three letters or more that are no stop words; lower-cased, each once, in order."""
    text = plain_text(c)
    tags = F.regexp_extract_all(text, F.lit(r"#([A-Za-z0-9_]+)"), F.lit(1))
    rest = F.regexp_replace(text, r"#[A-Za-z0-9_]+", " ")
    words = F.regexp_extract_all(rest, F.lit(r"(?<![A-Za-z0-9_])[a-zA-Z]{3,}(?![A-Za-z0-9_])"), F.lit(0))
    lower = lambda a: F.transform(a, F.lower)
    return F.filter(F.array_distinct(F.concat(lower(tags), lower(words))), lambda w: ~w.isin(*STOP_WORDS))


def hashtags(c: Column) -> Column:
    """All hashtags in order, lower-cased, repeats kept; letters of any script."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)#(\w+)"), F.lit(1)), F.lower)


def share_type(media: Column, link: Column) -> Column:
    return F.when(trim(media) != "", "media").when(trim(link) != "", "links").otherwise("textOnly")


def truncate(c: Column, most: int = 50) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
