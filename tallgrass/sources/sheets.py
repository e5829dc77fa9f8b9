"""A data source for spreadsheets exported from a table browser, read with the standard library.

The header is the first of the first 25 rows that holds the anchor, or at least three cells that look
like technical field names. All values are text; numbers without fraction lose their ``.0``; empty cells
are null; blank rows and columns without a header are left out.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# What a technical field name looks like, and in how many rows the header is looked for.
FIELD = re.compile(r"^[A-Z][A-Z0-9_]{1,29}$")
HEADER_ROWS = 25


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(path: str) -> Iterator[list[str | None]]:
    """The rows of the first sheet as texts, one at a time."""
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{NS}t")))
        name = next(n for n in sorted(book.namelist()) if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        with book.open(name) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{NS}row":
                    continue
                out: list[str | None] = []
                for i, cell in enumerate(row):
                    at = _column(cell.get("r")) if cell.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    kind, value = cell.get("t"), cell.find(f"{NS}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{NS}t")) if kind == "inlineStr" else value.text if value is not None else None
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                    elif kind is None and text and re.fullmatch(r"-?\d+\.0+", text):
                        text = text.split(".")[0]
                    out[at] = text.strip() or None if text is not None else None
                row.clear()
                yield out


def header(path: str, anchor: str | None = None) -> tuple[int, list[tuple[int, str]]]:
    """(row number, [(column, name)]) of the header; ValueError if there is none."""
    for i, row in enumerate(rows(path)):
        if i >= HEADER_ROWS:
            break
        named = [(k, v) for k, v in enumerate(row) if v]
        if anchor in row if anchor else sum(bool(FIELD.match(v)) for _, v in named) >= 3:
            return i, named
    raise ValueError(f"no header in the first {HEADER_ROWS} rows of {path}")


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> StructType:
        _, named = header(self.options["path"], self.options.get("anchor"))
        return StructType([StructField(n, StringType()) for _, n in named])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.options["path"], self.options.get("anchor"))


class SheetReader(DataSourceReader):
    def __init__(self, path: str, anchor: str | None):
        self.path, self.anchor = path, anchor

    def read(self, partition) -> Iterator[tuple]:
        start, named = header(self.path, self.anchor)
        for i, row in enumerate(rows(self.path)):
            values = tuple(row[k] if k < len(row) else None for k, _ in named)
            if i > start and any(v is not None for v in values):
                yield values
