"""Cells of workbooks as a table function: sheet, row, column and the text that a reader of the sheet sees.

Numbers are written by their cell's format: decimals, thousands, percents, dates and times. Formats that aren't known show the number.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from xml.etree import ElementTree

from pyspark.sql import DataFrame, functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: The formats that ECMA-376 gives by number alone.
FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss",
    22: "m/d/yy h:mm", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00", 45: "mm:ss", 49: "@",
}

_DATE = re.compile(r"AM/PM|y+|m+|d+|h+|s+|.", re.IGNORECASE)


def _general(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e11 else f"{x:.11g}".replace("e", "E")


def _dated(x: float, code: str, old: bool) -> str:
    """A day number since the end of 1899 (or 1904) by a date format; days before March 1900 are one late, as sheets count a 29 February."""
    day = x + 1462 if old else x
    when = dt.datetime(1899, 12, 30) + dt.timedelta(days=day + (1 if day < 60 else 0))
    when += dt.timedelta(microseconds=500)  # day fractions don't hold milliseconds
    parts, twelve, out = _DATE.findall(code), "am/pm" in code.lower(), []
    for i, p in enumerate(parts):
        low = p.lower()
        near = [q.lower()[0] for q in parts[:i][::-1] if q[0].isalpha()][:1] + [q.lower()[0] for q in parts[i + 1 :] if q[0].isalpha()][:1]
        if low == "am/pm":
            out.append("AM" if when.hour < 12 else "PM")
        elif low[0] == "y":
            out.append(f"{when.year:04d}" if len(p) > 2 else f"{when.year % 100:02d}")
        elif low[0] == "m" and ((i and near[0] == "h") or near[-1:] == ["s"]) and len(p) < 3:  # minutes
            out.append(f"{when.minute:0{len(p)}d}")
        elif low[0] == "m":
            out.append(when.strftime("%B" if len(p) > 3 else "%b") if len(p) > 2 else f"{when.month:0{len(p)}d}")
        elif low[0] == "d":
            out.append(when.strftime("%A" if len(p) > 3 else "%a") if len(p) > 2 else f"{when.day:0{len(p)}d}")
        elif low[0] == "h":
            out.append(f"{(when.hour - 1) % 12 + 1 if twelve else when.hour:0{len(p)}d}")
        elif low[0] == "s":
            out.append(f"{when.second:0{len(p)}d}")
        else:
            out.append(p)
    return "".join(out)


def shown(x: float, code: str, old: bool = False) -> str:
    """A number by a format code: its first section, or the second for a negative number if there is one."""
    sections = re.split(r";(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", code)
    negative = x < 0 and len(sections) > 1
    part = sections[1] if negative else sections[0]
    bare = re.sub(r'\[[^\]]*\]|"[^"]*"|\\.|_.|\*.', "", part)
    if re.search(r"[ymdhs]", bare, re.IGNORECASE) and not re.search(r"general|[0#]", bare, re.IGNORECASE):
        date = re.sub(r"\[[^\]]*\]|[\"\\]", "", part)
        return _dated(x, date, old) if 0 <= x < 2_958_466 else _general(x)
    if not re.search(r"[0#?]", bare):
        return _general(x)
    decimals = len(re.search(r"\.([0#?]*)", bare)[1]) if "." in bare else 0
    value = Decimal(repr(abs(x) if negative else x)) * (100 if "%" in bare else 1)
    number = f"{value.quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP):{',' if re.search('[0#],[0#]', bare) else ''}f}"
    first, last = re.search(r"[0#?]", part).start(), max(m.end() for m in re.finditer(r"[0#?]", part))
    clean = lambda s: re.sub(r'\[[^\]]*\]|_.|\*.|["\\]', "", s)
    return clean(part[:first]) + number + clean(part[last:])


def cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """``(sheet, row, column, text)`` of the cells that show something, in order."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    xml = lambda name: ElementTree.fromstring(book.read(name))
    texts = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
    shared = [texts(s) for s in xml("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
    target = {x.get("Id"): x.get("Target") for x in xml("xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
    codes = []
    if "xl/styles.xml" in names:
        styles = xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{MAIN}numFmt")}
        kinds = styles.find(f"{MAIN}cellXfs")
        codes = [(own.get(k) or FORMATS.get(k, "General")) for k in (int(f.get("numFmtId", 0)) for f in (kinds if kinds is not None else ()))]
    root = xml("xl/workbook.xml")
    settings = root.find(f"{MAIN}workbookPr")
    old = settings is not None and settings.get("date1904") in ("1", "true")
    for i, sheet in enumerate(root.iter(f"{MAIN}sheet"), 1):
        place = target.get(sheet.get(RELATION), f"worksheets/sheet{i}.xml")  # a book without relationships has its sheets in order
        for c in xml(place.lstrip("/") if place.startswith("/") else f"xl/{place}").iter(f"{MAIN}c"):
            value, kind = c.find(f"{MAIN}v"), c.get("t", "n")
            text = texts(c) if value is None else value.text or ""
            if kind == "s" and text:
                text = shared[int(text)]
            elif kind == "b":
                text = "TRUE" if text == "1" else "FALSE"
            elif kind == "n" and value is not None and text:
                style = int(c.get("s", 0))
                text = shown(float(text), codes[style] if style < len(codes) else "General", old)
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            column = 0
            for x in letters:
                column = column * 26 + ord(x) - 64
            if text.strip():
                yield sheet.get("name"), int(row), column, text.strip()


@F.udtf(returnType="sheet string, `row` int, `column` int, text string, error string")
class SheetCells:
    """Cells of a workbook's bytes; one row with ``PARSE_FAILED`` alone for what is none, nothing for null."""

    def eval(self, data: bytes):
        if data is None:
            return
        try:
            found = list(cells(bytes(data)))
        except Exception:  # noqa: BLE001  whatever a broken book raises is its error
            found = [(None, None, None, None, "PARSE_FAILED")]
        for x in found:
            yield (*x, None)[:5]


def sheet_cells(files: DataFrame, content: str = "content") -> DataFrame:
    """The columns of ``files`` but the content, and a row for each cell: ``sheet``, ``row``, ``column``, ``text``, ``error``. A book
    without cells has no row."""
    kept = [c for c in files.columns if c != content]
    return files.lateralJoin(SheetCells(F.col(content).outer())).select(*kept, "sheet", "row", "column", "text", "error")
