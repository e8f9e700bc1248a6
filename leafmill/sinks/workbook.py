"""A minimal spreadsheet writer: text cells only, bold frozen headings, no formulas.

A workbook is one file for people to read, so its rows pass through the driver one at a time, up to
the format's own limit of rows a sheet; tables beyond that belong in the other exports and raise.
"""

from __future__ import annotations

import os
import tempfile
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

MOST_ROWS = 1_048_575
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(text: str, style: int = 0) -> str:
    return f'<c t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(_BAD.sub("", text))}</t></is></c>'


def _name(title: str, used: set[str]) -> str:
    base = re.sub(r"[\\/?*\[\]:]", " ", title)[:31] or "Sheet"
    name, i = base, 2
    while name.lower() in used:
        name, i = f"{base[:28]} {i}", i + 1
    used.add(name.lower())
    return name


def write_workbook(sheets: dict[str, DataFrame], path: str, widths: bool = True) -> None:
    """Write tables of text columns; an empty one gets ``status: empty``. A partial file is never seen."""
    from leafmill.sinks.exports import column_widths

    for title, table in sheets.items():  # before anything is written
        if table.count() > MOST_ROWS:
            raise ValueError(f"more rows than a sheet holds: {title}")
    used: set[str] = set()
    names = [_name(t, used) for t in sheets]
    handle, part = tempfile.mkstemp(suffix=".xlsx")  # on the driver only, and gone when the file is where it belongs
    os.close(handle)
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + kinds + "</Types>",
        )
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="rId{len(names) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, table in enumerate(sheets.values(), 1):
            wide = column_widths(table) if widths else {}
            rows = iter(table.toLocalIterator())
            first = next(rows, None)
            columns = table.columns if first is not None else ["status"]
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                cols = "".join(f'<col min="{j}" max="{j}" width="{wide.get(c, 12)}" customWidth="1"/>' for j, c in enumerate(columns, 1))
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData><row>{"".join(_cell(c, 1) for c in columns)}</row>'.encode())
                if first is None:
                    f.write(f"<row>{_cell('empty')}</row>".encode())
                else:
                    row = first
                    while row is not None:
                        f.write(f"<row>{''.join(_cell('' if v is None else str(v)) for v in row)}</row>".encode())
                        row = next(rows, None)
                f.write(b"</sheetData></worksheet>")
    _deliver(next(iter(sheets.values())).sparkSession, part, path)


def _deliver(spark, part: str, path: str) -> None:
    """Move a local file to where Spark's file systems find ``path``, whole or not at all."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{part}"), beside)
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"can't write {path}")


def read_workbook(path: str) -> dict[str, list[dict[str, str]]]:
    """What :func:`write_workbook` wrote, as rows by heading."""
    import xml.etree.ElementTree as ET

    ns = {"m": _MAIN}
    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", ns)]
        out = {}
        for i, name in enumerate(names, 1):
            rows = [["".join(c.itertext()) for c in r.iterfind("m:c", ns)] for r in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iterfind(".//m:row", ns)]
            out[name] = [dict(zip(rows[0], r, strict=True)) for r in rows[1:]]
    return out
