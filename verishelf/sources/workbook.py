"""Sheets of Office Open XML workbooks as rows of text, by the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
}


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(n: int) -> str:
    name = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def _text(node) -> str:
    """The text runs of a cell or shared string, phonetic hints left out."""
    return "".join(t.text or "" for run in ([node] if node.tag == f"{_MAIN}t" else [x for x in node if x.tag != f"{_MAIN}rPh"]) for t in ([run] if run.tag == f"{_MAIN}t" else run.iter(f"{_MAIN}t")))


def read_sheet(data: bytes, sheet: str | int = 0) -> list[list[str | None]]:
    """The rows of a sheet, by name or place. Numbers stay as they are written; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        listed = [(x.get("name"), x.get(_REL)) for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = [r for i, (name, r) in enumerate(listed) if sheet in (i, name)]
        if not found:
            raise ValueError(f"no sheet {sheet!r} among {[name for name, _ in listed]}")
        target = targets[found[0]]
        tree = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows: list[list[str | None]] = []
    for row in tree.iter(f"{_MAIN}row"):
        at = int(row.get("r") or len(rows) + 1)
        rows += [[] for _ in range(at - 1 - len(rows))]
        cells: list[str | None] = []
        for c in row.iter(f"{_MAIN}c"):
            k = column_number(c.get("r")) if c.get("r") else len(cells)
            value, inline = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
            text = _text(inline) if inline is not None else None if value is None else value.text
            if c.get("t") == "s" and text is not None:
                text = shared[int(text)]
            elif c.get("t") == "b" and text is not None:
                text = "TRUE" if text == "1" else "FALSE"
            cells += [None] * (k - len(cells)) + [text or None]
        rows.append(cells)
    return rows


def write_sheet(rows: list[list[str | None]]) -> bytes:
    """A workbook with these rows as text cells. Times and order within the file are fixed."""
    clean = lambda t: escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", t))
    cell = lambda i, j, t: f'<c r="{column_name(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{clean(t)}</t></is></c>'
    body = "".join(f'<row r="{i}">' + "".join(cell(i, j, t) for j, t in enumerate(row) if t is not None) + "</row>" for i, row in enumerate(rows, 1))
    parts = _PARTS | {"xl/worksheets/sheet1.xml": f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _XML + parts[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()
