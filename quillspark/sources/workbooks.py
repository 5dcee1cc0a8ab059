"""Workbooks: grids of strings to and from XLSX files, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(n: int) -> str:
    out = ""
    while n >= 0:
        n, r = divmod(n, 26)
        out, n = chr(65 + r) + out, n - 1
    return out


def write_grids(grids: list[list[list[str]]], names: list[str] | None = None) -> bytes:
    """A workbook of one sheet for each grid, all cells as inline strings."""
    names = names or [f"Sheet{i + 1}" for i in range(len(grids))]
    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(grids)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(grids))) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        for i, grid in enumerate(grids):
            rows = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{_column(c)}{r + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(grid))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def read_grids(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet name, rows) of a workbook; inline and shared strings; anything else gives nothing."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
        out = []
        for i, name in enumerate(names):
            grid: list[list[str]] = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i + 1}.xml")).iter(f"{_NS}row"):
                cells: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = c.find(f"{_NS}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if value is None else value.text or ""
                    cells.append(shared[int(text)] if c.get("t") == "s" else text)
                grid.append(cells)
            out.append((name, grid))
        return out
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
        return []


def workbook_cells(files: DataFrame) -> DataFrame:
    """The cells of binaryFile rows (path, content): path, sheet, row, col, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(p, name, r, c, v) for p, data in zip(batch["path"], batch["content"]) for name, grid in read_grids(bytes(data)) for r, row in enumerate(grid) for c, v in enumerate(row)]
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "col", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, col int, text string")
