"""Reading export CSV files: bytes to text, a dialect Spark's reader lacks, headers, kinds.

An open quote anywhere changes all that follows, yet a large file is read in ranges, by many tasks.
Each range is scanned for what it makes of every state that it may begin in: a new row, a quoted
section, a field with an escaped line break. These maps, one row a range, are applied one after the
other, and say what each range begins in. Then every range is parsed, once; a row that goes over a
range's end is put together from its parts. Rows carry the file and their place in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.constants import MISSING
from tracewell.operators.stored import stored
from tracewell.sources.specs import SPECS, ExportSpec

#: What Windows-1252 has at 0x80 to 0x9F; five bytes there stand for themselves.
_C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_C1_FROM = "".join(map(chr, range(0x80, 0xA0)))
#: Lines in which a file's header is looked for.
HEAD_LINES = 100


class ExportError(ValueError):
    """A file that cannot be read as the export it should be."""


def decode(content: Column, encoding: str | None = None) -> Column:
    """Text of bytes: UTF-8 without its mark, or all of it Windows-1252 where any of it is no UTF-8."""
    if encoding:
        return F.decode(content, encoding)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), _C1_FROM, _C1))
    return F.regexp_replace(text, "^﻿", "")


def iter_rows(text: str, escape: str | None = None, max_columns: int = 0, max_field_chars: int = 0) -> Iterator[list[str]]:
    """The rows of a CSV text, one at a time, without the blank ones at its end. A quote opens a section only at a
    field's start; an escape makes the next character plain. Characters between special ones are taken as one piece."""
    special = re.compile('[,"\\r\\n' + re.escape(escape or "") + "]")
    row, cell, quoted, started, i, n, blank = [], [], False, False, 0, len(text), []

    def end_cell():
        nonlocal started
        row.append("".join(cell))
        if max_field_chars and len(row[-1]) > max_field_chars:
            raise ExportError(f"a field of more than {max_field_chars} characters")
        if max_columns and len(row) > max_columns:
            raise ExportError(f"a row of more than {max_columns} columns")
        cell.clear()
        started = False

    while i < n:
        found = special.search(text, i)
        stop = found.start() if found else n
        if stop > i:
            cell.append(text[i:stop])
            started, i = True, stop
            continue
        c, after = text[i], text[i + 1 : i + 2]
        i += 1
        if escape and c == escape:
            if not after:
                raise ExportError("the text ends in an escape")
            cell.append(after)
            started, i = True, i + 1
        elif quoted:
            if c != '"':
                cell.append("" if c == "\r" and after == "\n" else c)
            elif after == '"':
                cell.append('"')
                i += 1
            else:
                quoted = False
        elif c == '"':
            if started:
                cell.append(c)
            quoted = quoted or not started
            started = True
        else:
            end_cell()
            if c == ",":
                continue
            i += c == "\r" and after == "\n"
            blank.append(row)
            if any(row):
                yield from blank
                blank = []
            row = []
    if quoted:
        raise ExportError("a quote is not closed")
    if row or cell or started:
        end_cell()
        if any(row):
            yield from blank
            yield row


def rows_of(text: str, escape: str | None = None) -> list[list[str]]:
    """All rows of a CSV text."""
    return list(iter_rows(text, escape))


def header_of(row: list[str]) -> list[str]:
    names = [c.lstrip("﻿").strip() for c in row]
    twice = sorted({x or "(blank)" for x in names if names.count(x) > 1})
    if twice:
        raise ExportError(f"Duplicate columns after header normalization: {', '.join(twice)}")
    return names


def kind_of(text: str) -> str | None:
    """The first kind whose required columns a text's header has; each by its own dialect, from the head alone where that is enough."""
    for part in (text[: 1 << 16], text):
        for spec in SPECS.values():
            try:
                names = header_of(next(islice(iter_rows(part, spec.escape), spec.skip_rows, None), []))
            except ExportError:
                continue
            if names and set(spec.required) <= set(names):
                return spec.kind
    return None


def _blank(row: list[str]) -> bool:
    """Whether all cells of a row are missing."""
    return all(c.strip().upper() in ("", *MISSING) for c in row)


def records(text: str, spec: ExportSpec) -> Iterator[list[str]]:
    """Cells in the spec's column order; absent columns are blank. ExportError where the file is not the spec's."""
    if spec.max_chars and len(text) > spec.max_chars:
        raise ExportError(f"more than {spec.max_chars} characters")
    rows = islice(iter_rows(text, spec.escape, spec.max_columns, spec.max_field_chars), spec.skip_rows, None)
    first = next(rows, None)
    if first is None:
        raise ExportError("the file is empty")
    names = header_of(first)
    lacking = [c for c in spec.required if c not in names]
    if lacking:
        other = kind_of(text)
        hint = f" This looks like a {other} file, not {spec.kind}." if other and other != spec.kind else "" if other else f" This does not look like a {spec.kind} export."
        raise ExportError(f"Missing required columns: {', '.join(lacking)}.{hint}")
    place = [names.index(c) if c in names else None for c in spec.names]
    seen = 0
    for row in rows:
        if _blank(row):
            continue
        if len(row) > len(names):
            raise ExportError("a row is wider than the header")
        seen += 1
        if spec.max_rows and seen > spec.max_rows:
            raise ExportError(f"more than {spec.max_rows} rows")
        yield [row[k] if k is not None and k < len(row) else "" for k in place]


# What a line may begin in: a new row, a quoted section, an unquoted field whose line break was escaped.
ROW, QUOTED, PLAIN = 0, 1, 2


def state_after(line: str, state: int, escape: str | None = None, ended: bool = True) -> int:
    """The state of the line after this one, or, where no line break ended it, whether its last section is open. ExportError where it ends in an escape."""
    special = re.compile('[,"\\r' + re.escape(escape or "") + "]")
    quoted, started, i, n = state == QUOTED, state != ROW, 0, len(line)
    while i < n:
        found = special.search(line, i)
        stop = found.start() if found else n
        if stop > i:
            started, i = True, stop
            continue
        c, i = line[i], i + 1
        if escape and c == escape:
            if i == n:
                if not ended:
                    raise ExportError("the text ends in an escape")
                return QUOTED if quoted else PLAIN
            started, i = True, i + 1
        elif quoted:
            if c == '"':
                if line[i : i + 1] == '"':
                    i += 1
                else:
                    quoted = False
        elif c == '"':
            quoted, started = not started, True
        else:
            started = False
    return QUOTED if quoted else ROW


def _lines(spark: SparkSession, path: str, encoding: str | None) -> DataFrame:
    """file, size, start (of the file range that a task reads) and line, the bytes between line feeds, in order within a range.

    Spark cuts large files into ranges at line feeds. A named encoding may have such bytes elsewhere, so
    these files are decoded whole and are one range each.
    """
    if encoding:
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("text"))
        text = F.regexp_replace("text", "^\ufeff", "")
        return files.select("file", F.octet_length(text).cast("long").alias("size"), F.lit(0).cast("long").alias("start"), F.explode(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")).alias("line")).withColumn("line", F.col("line").cast("binary"))
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Iterator[bytes]]]:
    """(file, its size, start, lines) of each range that a task reads; a range's rows follow each other."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "size", "start", "line")), strict=True))
    for (file, size, start), some in groupby(rows, key=lambda r: r[:3]):
        yield file, size, start, (r[3] for r in some)


def _scan(lines: DataFrame, escape: str | None) -> DataFrame:
    """One row a file range: the state after it for each state before it, its bytes with line feeds, and whether all of it is UTF-8."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, whole, start, some in _by_range(batches):
            states, size, valid, last = [ROW, QUOTED, PLAIN], 0, True, b""
            for raw in some:
                size, last = size + len(raw) + 1, raw
                if not raw.isascii():
                    try:
                        raw.decode()
                    except UnicodeDecodeError:
                        valid = False
                if b'"' in raw or (escape and escape.encode() in raw):
                    line = raw.decode("latin-1")
                    after = {x: state_after(line, x, escape) for x in set(states)}
                    states = [after[x] for x in states]
                else:
                    states = [QUOTED if x == QUOTED else ROW for x in states]
            yield pa.RecordBatch.from_pydict({"file": [file], "size": [whole], "start": [start], "states": [states], "bytes": [size], "valid": [valid], "last": [last]}, schema=schema)

    schema = pa.schema([("file", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("states", pa.list_(pa.int32())), ("bytes", pa.int64()), ("valid", pa.bool_()), ("last", pa.binary())])
    return lines.mapInArrow(work, "file string, size long, start long, states array<int>, bytes long, valid boolean, last binary")


def _ranges(spark: SparkSession, lines: DataFrame, escape: str | None) -> DataFrame:
    """The scanned ranges with `before`, the state that each begins in: the maps of those before it, one applied after the other."""
    scanned = _scan(lines, escape)
    order = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    maps = F.coalesce(F.collect_list("states").over(order), F.array())
    before = F.aggregate(maps, F.lit(ROW), lambda state, m: F.element_at(m, state + 1))
    return stored(scanned.withColumn("before", before).withColumn("valid", F.min("valid").over(W.partitionBy("file"))))


def _parse(lines: DataFrame, spec: ExportSpec, before: dict, invalid: set) -> DataFrame:
    """Rows of each range: file, start, seq, cells; `open` marks the part of a row that ends in a later range (1) or begins in an earlier one (-1), as text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, _, start, some in _by_range(batches):
            out, seq, chars, state, part = [], 0, 0, before.get((file, start), ROW), []
            carried = state != ROW

            def decoded(raw: bytes) -> str:
                return raw.decode("latin-1").translate(_C1_TABLE) if file in invalid else raw.decode()

            def batch() -> pa.RecordBatch:
                columns = list(zip(*out, strict=True)) if out else [[] for _ in _PARSED]
                return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PARSED, strict=True)], schema=_PARSED)

            for k, raw in enumerate(some):
                line = decoded(raw)
                if k == 0 and start == 0:
                    line = line.removeprefix("\ufeff")
                chars += len(line) + 1
                simple = '"' not in line and not (escape and escape in line)
                state = (QUOTED if state == QUOTED else ROW) if simple else state_after(line, state, escape)
                part.append(line)
                if state != ROW:
                    continue
                text, part = "\n".join(part), []
                if carried:
                    carried = False
                    out.append((file, start, -1, None, text, -1, None, 0, None))
                    continue
                try:
                    rows, wrong = _rows(text, spec), None
                except ExportError as e:
                    rows, wrong = [[]], str(e)
                for row in rows:
                    out.append((file, start, seq, row, None, 0, wrong, 0, not _blank(row)))
                    seq += 1
                if len(out) >= 4096:
                    yield batch()
                    out.clear()
            if part:
                out.append((file, start, -1 if carried else seq, None, "\n".join(part), -1 if carried else 1, None, 0, None))
            out.append((file, start, -2, None, None, 2, None, chars, None))  # the range's own row
            yield batch()

    escape = spec.escape
    return lines.mapInArrow(work, "file string, start long, seq long, cells array<string>, text string, open int, wrong string, chars long, kept boolean")


_C1_TABLE = str.maketrans(_C1_FROM, _C1)
_PARSED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("cells", pa.list_(pa.string())), ("text", pa.string()), ("open", pa.int32()), ("wrong", pa.string()), ("chars", pa.int64()), ("kept", pa.bool_())])


def _rows(text: str, spec: ExportSpec) -> list[list[str]]:
    """The rows of a text that begins and ends with a row; one blank row where it has none."""
    if not any(c in text for c in '"\r' + (spec.escape or "")) and not spec.max_columns and not spec.max_field_chars:
        return [text.split(",")]
    out = list(iter_rows(text, spec.escape, spec.max_columns, spec.max_field_chars))
    return out or [[""]] * (1 + text.rstrip("\r").count("\r"))


def _joined(parsed: DataFrame, spec: ExportSpec) -> DataFrame:
    """The rows that ranges share, put together from their parts; a row's parts belong to the range in which it begins."""
    parts = parsed.where("open in (-1, 1)").select("file", "start", "seq", "text", "open")
    owner = F.max(F.when(F.col("open") == 1, F.struct("start", "seq"))).over(W.partitionBy("file").orderBy("start", "open").rowsBetween(W.unboundedPreceding, 0))  # at most two rows a range
    whole = parts.withColumn("owner", owner).groupBy("file", F.col("owner.start").alias("start"), F.col("owner.seq").alias("seq")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "open", "text"))), lambda x: x["text"]), "\n").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, start, seq, text in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "seq", "text")), strict=True):
                try:
                    text += "\n" * _ends_in(text.encode(), spec.escape)  # a line break that was escaped at the file's end
                    out += [(file, start, seq + k, row, None, 0, None, 0, not _blank(row)) for k, row in enumerate(_rows(text, spec))]
                except ExportError as e:
                    out.append((file, start, seq, [], None, 0, str(e), 0, False))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in _PARSED]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PARSED, strict=True)], schema=_PARSED)

    return whole.mapInArrow(work, parsed.schema)


def read_raw(spark: SparkSession, path: str, spec: ExportSpec) -> DataFrame:
    """file, row_idx, error and the spec's columns as text; a file that cannot be read is one row with its error.

    The files are scanned once for the state that each range begins in, and parsed once; what is parsed is stored.
    """
    lines = _lines(spark, path, spec.encoding)
    ranges = _ranges(spark, lines, spec.escape)
    last = ranges.groupBy("file").agg(F.max_by(F.struct("states", "before", "last"), "start").alias("x"), F.max("size").alias("size"), F.sum("bytes").alias("bytes"), F.min("valid").alias("valid"))
    end = F.element_at(F.col("x.states"), F.col("x.before") + 1)
    files = stored(last.select("file", "bytes", "size", "valid", end.alias("end"), F.col("x.last").alias("last"), F.col("x.before").alias("before")))
    odd = {(r.file, r.start): r.before for r in ranges.where(f"before <> {ROW}").select("file", "start", "before").collect()}
    invalid = {r.file for r in files.where("not valid").select("file").collect()}
    parsed = stored(_parse(lines, spec, odd, invalid))
    rows = parsed.where("open = 0").drop("text", "open", "chars")
    rows = rows.unionByName(_joined(parsed, spec).drop("text", "open", "chars"))
    # Places: counts by range, summed over the ranges of a file.
    by_range = rows.groupBy("file", "start").agg(F.max("seq").alias("n"), F.count_if("kept").alias("n_kept"))
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    by_range = by_range.select("file", "start", F.coalesce(F.sum(F.col("n") + 1).over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("n_kept").over(earlier), F.lit(0)).alias("_kept"))
    place = F.sum(F.col("kept").cast("long")).over(W.partitionBy("file", "start").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_in", F.coalesce(place, F.lit(0))).join(by_range, ["file", "start"]).withColumn("row", F.col("_rows") + F.col("seq")).withColumn("at", F.col("_kept") + F.col("_in"))
    rows = stored(rows.select("file", "row", "at", "kept", "cells", "wrong"))
    return _checked(spark, rows, files, parsed, spec)


def _checked(spark: SparkSession, rows: DataFrame, files: DataFrame, parsed: DataFrame, spec: ExportSpec) -> DataFrame:
    """The rows below the headers by the spec's columns, of files that are as they should be; one row with the error of any other."""
    heads = rows.where(F.col("row") <= spec.skip_rows).groupBy("file").agg(F.max(F.when(F.col("row") == spec.skip_rows, F.struct("cells"))).alias("h"), F.count_if("kept").alias("above"))
    below = rows.where(F.col("row") > spec.skip_rows)
    facts = below.groupBy("file").agg(F.count_if("kept").alias("rows"), F.max(F.when(F.col("kept"), F.size("cells"))).alias("widest"), F.max("row").alias("end_row"))
    facts = files.join(heads, "file", "left").join(facts, "file", "left").join(rows.groupBy("file").agg(F.min("wrong").alias("wrong"), F.max(F.when(F.col("kept"), F.col("row"))).alias("last_row")), "file", "left")
    facts = facts.join(parsed.where("open = 2").groupBy("file").agg(F.sum("chars").alias("chars")), "file", "left").collect()  # one row a file
    good, wrong = [], []
    for f in facts:
        try:
            names = _header(spark, f, spec)
        except ExportError as e:
            wrong.append((f.file, str(e)))
        else:
            good.append((f.file, f.above, [names.index(c) + 1 if c in names else 0 for c in spec.names]))
    schema = "file string, row_idx long, error string, " + ", ".join(f"`{c}` string" for c in spec.names)
    cell = lambda k: F.when(F.col("places")[k] > 0, F.coalesce(F.get("cells", F.col("places")[k] - 1), F.lit(""))).otherwise(F.lit(""))
    out = spark.createDataFrame([(f, -1, e, *[""] * len(spec.names)) for f, e in wrong], schema)
    if good:
        places = spark.createDataFrame(good, "file string, above long, places array<int>")
        found = below.where("kept").join(F.broadcast(places), "file")  # a row a file, gathered above
        out = found.select("file", (F.col("at") - F.col("above")).alias("row_idx"), F.lit(None).cast("string").alias("error"), *[cell(k).alias(c) for k, c in enumerate(spec.names)]).unionByName(out)
    return out


def _header(spark: SparkSession, f: Row, spec: ExportSpec) -> list[str]:
    """The column names of a file by its facts; ExportError where it is not the spec's."""
    if spec.max_bytes and f.size > spec.max_bytes:
        raise ExportError(f"more than {spec.max_bytes} bytes")
    chars = f.chars - (f.size < f.bytes)  # a last line without its line feed
    if spec.max_chars and chars > spec.max_chars:
        raise ExportError(f"more than {spec.max_chars} characters")
    if f.size < f.bytes:
        state_after(f.last.decode("latin-1"), ROW if f.before is None else f.before, spec.escape, ended=False) if _ends_in(f.last, spec.escape) else None
    if f.end == QUOTED:
        raise ExportError("a quote is not closed")
    if f.wrong:
        raise ExportError(f.wrong)
    if f.h is None or f.last_row is None or f.last_row < spec.skip_rows:
        raise ExportError("the file is empty")
    names = header_of(f.h.cells)
    lacking = [c for c in spec.required if c not in names]
    if lacking:
        other = kind_of(_head(spark, f.file, spec.encoding))
        hint = f" This looks like a {other} file, not {spec.kind}." if other and other != spec.kind else "" if other else f" This does not look like a {spec.kind} export."
        raise ExportError(f"Missing required columns: {', '.join(lacking)}.{hint}")
    if (f.widest or 0) > len(names):
        raise ExportError("a row is wider than the header")
    if spec.max_rows and (f.rows or 0) > spec.max_rows:
        raise ExportError(f"more than {spec.max_rows} rows")
    return names


def _ends_in(line: bytes, escape: str | None) -> bool:
    """Whether a line ends in an escape that nothing precedes to make it plain."""
    if not escape:
        return False
    mark = escape.encode()
    return (len(line) - len(line.rstrip(mark))) % 2 == 1


def _head(spark: SparkSession, path: str, encoding: str | None = None) -> str:
    """The first HEAD_LINES lines of a file, or of the first of many, whole: a cut between bytes could make it another text."""
    lines = _lines(spark, path, encoding).where("start = 0").select("line").limit(HEAD_LINES).collect()
    raw = b"\n".join(bytes(r.line) for r in lines)
    try:
        return raw.decode().removeprefix("\ufeff")
    except UnicodeDecodeError:
        return raw.decode("latin-1").translate(_C1_TABLE)


def read_export(spark: SparkSession, path: str, kind: str = "auto", **limits) -> DataFrame:
    """The raw rows of one export; kind `auto` looks at the header. ExportError where a file cannot be read."""
    if spark.read.format("binaryFile").load(path).select("path").isEmpty():  # Spark passes over files without bytes
        raise ExportError("the file is empty")
    if kind == "auto":
        kind = kind_of(_head(spark, path, limits.get("encoding")))
        if kind is None:
            raise ExportError("the file is none of " + ", ".join(SPECS))
    rows = read_raw(spark, path, replace(SPECS[kind], **limits))
    bad = rows.where("error is not null").select("file", "error").first()
    if bad:
        raise ExportError(f"{bad.file}: {bad.error}")
    return rows.drop("error")
