"""Cells of an xlsx workbook: a zip of XML parts. Small helper for the Excel reader and writer."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[s.get(_REL)].lstrip("/")
        found.append((s.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return found


def sheet_names(source) -> list[str]:
    with zipfile.ZipFile(source) as book:
        return [name for name, _ in _sheets(book)]


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _value(cell, shared: list[str]):
    kind, raw = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw == "1"
    if kind in ("str", "e"):
        return raw
    number = float(raw)
    return int(number) if number.is_integer() and "." not in raw else number


def sheet_rows(source, sheet: int | str = 0) -> list[list]:
    """Rows of one sheet as lists of equal length; absent cells are None."""
    with zipfile.ZipFile(source) as book:
        sheets = _sheets(book)
        target = dict(sheets)[sheet] if isinstance(sheet, str) else sheets[sheet][1]
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t"))
                      for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        rows = []
        for row in ElementTree.fromstring(book.read(target)).iter(f"{_MAIN}row"):
            cells = {}
            for place, cell in enumerate(row.iter(f"{_MAIN}c")):
                reference = cell.get("r")
                cells[_column(reference) if reference else place] = _value(cell, shared)
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    width = max((len(r) for r in rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]


def write_rows(target, header: list[str], rows, sheet: str = "Sheet1") -> None:
    """A workbook with one sheet; text is stored inline."""
    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml",
                      f'<Types xmlns="{package}/content-types"><Default Extension="rels" '
                      'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                      f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
                      f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels",
                      f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" '
                      f'Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml",
                      f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" '
                      'r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels",
                      f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" '
                      f'Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f"<worksheet {main}><sheetData>".encode())
            for row in [header, *rows]:
                part.write(("<row>" + "".join(cell(v) for v in row) + "</row>").encode())
            part.write(b"</sheetData></worksheet>")
