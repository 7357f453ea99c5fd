"""A small workbook writer: one sheet, widths, wrapped columns, typed cells and links.

A workbook is one zip file for one reader, so its rows come to the driver as a local iterator,
one partition at a time; sheets hold 1,048,576 rows at most and more are an error, not cut off.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: rows of a sheet.
SHEET_ROWS = 1_048_576
_NS = "http://schemas.openxmlformats.org"


def column_name(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def auto_widths(df: DataFrame) -> list[int]:
    """The longest value and two more, between 10 and 60."""
    row = df.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(f"w{i}") for i, c in enumerate(df.columns)]).first()
    return [max(10, min(60, max(w or 0, len(c)) + 2)) for w, c in zip(row, df.columns, strict=True)]


def _cell(ref: str, value, style: int) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'
    if isinstance(value, tuple):  # (address, label): a link
        address, label = (str(x).replace('"', '""') for x in value)
        return f'<c r="{ref}" s="{style}" t="str"><f>{escape(f"""HYPERLINK("{address}","{label}")""")}</f><v>{escape(str(value[1]))}</v></c>'
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write(df: DataFrame, path: str, sheet: str = "Sheet1", widths: list[int] | None = None, wrap: tuple[str, ...] = ()) -> int:
    """Write df as a workbook at a driver path, whole or not at all; the number of rows."""
    widths = widths or auto_widths(df)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    os.close(handle)
    rows = 0
    try:
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="r1" Type="{_NS}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="r1" Type="{_NS}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_NS}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{_NS}/officeDocument/2006/relationships"><sheets><sheet name={escape(sheet)!r} sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_NS}/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf applyAlignment="1"><alignment horizontal="center"/></xf><xf applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf></cellXfs></styleSheet>')
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
                cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
                out.write(f'<worksheet xmlns="{_NS}/spreadsheetml/2006/main"><cols>{cols}</cols><sheetData>'.encode())
                styles = [2 if c in wrap else 0 for c in df.columns]
                out.write(f'<row r="1">{"".join(_cell(f"{column_name(i)}1", c, 1) for i, c in enumerate(df.columns))}</row>'.encode())
                for rows, row in enumerate(df.toLocalIterator(), 1):
                    if rows >= SHEET_ROWS:
                        raise ValueError(f"a sheet holds {SHEET_ROWS} rows")
                    out.write(f'<row r="{rows + 1}">{"".join(_cell(f"{column_name(i)}{rows + 1}", v, s) for i, (v, s) in enumerate(zip(row, styles, strict=True)))}</row>'.encode())
                out.write(b"</sheetData></worksheet>")
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
    return rows
