"""A workbook as a sink: df.write.format("workbook").mode("overwrite").save(path).

Executors write the rows of their partitions as pieces of the sheet, beside the workbook in a folder
that driver and executors must share; a piece is named after its task attempt, and tells the number of
its rows and the widths of its columns when it is done. The commit, on the driver, puts the pieces of the attempts
that counted together in the partitions' order, under another name, and then takes the workbook's name. A job
that fails, or whose rows are more than a sheet holds, leaves neither workbook nor pieces.

Cells are typed: numbers, booleans, texts; a struct of two texts (address, label) is a link. Blank
cells keep their place, rows shorter than the header are padded. Options: sheet, widths and wrap (comma-separated; by
default the longest value and two more, between 10 and 60).
"""

from __future__ import annotations

import os
import shutil
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from pyspark import TaskContext, cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a sheet; the bounds of a column's own width.
SHEET_ROWS = 1_048_576
NARROWEST, WIDEST = 10, 60
HEAD, WRAPPED = 1, 2
_NS = "http://schemas.openxmlformats.org"
_REL = f"{_NS}/officeDocument/2006/relationships"
_MAIN = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_FILES = {
    "[Content_Types].xml": f'<Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_MAIN}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_MAIN}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_MAIN}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="r1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_NS}/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf applyAlignment="1"><alignment horizontal="center"/></xf><xf applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf></cellXfs></styleSheet>',
}


def cell(value: object, style: int = 0) -> str:
    """A value in the place that follows the cell before it."""
    if value is None or value == "":
        return "<c/>"
    if isinstance(value, bool):
        return f'<c s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c s="{style}"><v>{value}</v></c>'
    if isinstance(value, tuple):
        address, label = ("" if x is None else str(x) for x in value)
        if not address:
            return cell(label, style)
        quoted = ('"' + x.replace('"', '""') + '"' for x in (address, label or address))
        return f'<c s="{style}" t="str"><f>{escape("HYPERLINK(" + ",".join(quoted) + ")")}</f><v>{escape(label or address)}</v></c>'
    return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _length(value: object) -> int:
    shown = value[-1] or value[0] if isinstance(value, tuple) else value
    return 0 if shown is None else len(str(shown))


@dataclass
class Piece(WriterCommitMessage):
    """What a task has written."""

    partition: int
    path: str
    rows: int
    widths: list[int] = field(default_factory=list)


class WorkbookWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.names = schema.names
        self.path = options["path"].removeprefix("file://")
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.sheet = options.get("sheet", "Sheet1")
        wrap = [x for x in options.get("wrap", "").split(",") if x]
        self.styles = [WRAPPED if c in wrap else 0 for c in self.names]
        self.widths = [int(x) for x in options.get("widths", "").split(",") if x]
        folder = os.path.dirname(os.path.abspath(self.path))
        self.pieces = os.path.join(folder, f".{os.path.basename(self.path)}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Piece:
        task = TaskContext.get()
        os.makedirs(self.pieces, exist_ok=True)
        done = Piece(task.partitionId(), os.path.join(self.pieces, f"{task.partitionId()}-{task.taskAttemptId()}"), 0, [0] * len(self.names))
        with open(done.path, "w", encoding="utf-8") as out:
            for row in iterator:
                values = [*row, *[None] * (len(self.names) - len(row))]
                done.widths = [max(w, _length(v)) for w, v in zip(done.widths, values, strict=True)]
                done.rows += 1
                if done.rows >= SHEET_ROWS:
                    raise ValueError(f"a sheet holds {SHEET_ROWS} rows")
                out.write("<row>" + "".join(map(cell, values, self.styles)) + "</row>")
        return done

    def commit(self, messages: list[Piece | None]) -> None:
        pieces = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        if sum(m.rows for m in pieces) >= SHEET_ROWS:
            self.abort(messages)
            raise ValueError(f"a sheet holds {SHEET_ROWS} rows")
        longest = [max([len(c), *(m.widths[k] for m in pieces)]) for k, c in enumerate(self.names)]
        widths = [*self.widths, *(max(NARROWEST, min(WIDEST, n + 2)) for n in longest[len(self.widths) :])]
        os.makedirs(self.pieces, exist_ok=True)
        whole = os.path.join(self.pieces, "whole")
        try:
            with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in _FILES.items():
                    z.writestr(name, text)
                z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{_REL}"><sheets><sheet name={quoteattr(self.sheet)} sheetId="1" r:id="r1"/></sheets></workbook>')
                with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
                    columns = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
                    head = "".join(cell(c, HEAD) for c in self.names)
                    out.write(f'<worksheet xmlns="{_NS}/spreadsheetml/2006/main"><cols>{columns}</cols><sheetData><row>{head}</row>'.encode())
                    for m in pieces:
                        with open(m.path, "rb") as part:
                            shutil.copyfileobj(part, out, 1 << 20)
                    out.write(b"</sheetData></worksheet>")
            os.replace(whole, self.path)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Piece | None]) -> None:
        shutil.rmtree(self.pieces, ignore_errors=True)


class Workbook(DataSource):
    """The sink's name is `workbook`; the path is one that Python opens on driver and executors alike."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the sink known to a session; its code travels with the job."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Workbook)
