"""Cells as a reader of the sheet sees them."""

import io
import zipfile

import pytest
from folioforge.sources import files, sheets
from pyspark.sql import functions as F

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(rows, formats=(), shared=(), extra=""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}>{extra}<sheets><sheet name="One"/><sheet name="Two"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData><row><c r="AB2"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        own = "".join(f'<numFmt numFmtId="{170 + i}" formatCode="{f}"/>' for i, f in enumerate(formats))
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts>{own}</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="10"/>{"".join(f"<xf numFmtId=\"{170 + i}\"/>" for i in range(len(formats)))}</cellXfs></styleSheet>')
    return data.getvalue()


def test_dates_percents_and_shared_strings(spark):
    rows = '<row><c r="A1" t="s"><v>1</v></c><c r="B1" s="1"><v>45296</v></c><c r="C1" s="2"><v>0.12345</v></c><c r="D1" t="b"><v>1</v></c><c r="E1"><v>3.10</v></c></row><row><c r="A2" s="3"><v>45296.75</v></c><c r="B2" t="inlineStr"><is><t> in </t></is></c><c r="C2"/><c r="D2" t="e"><v>#N/A</v></c></row>'
    data = spark.createDataFrame([(1, bytearray(book(rows, ["yyyy\\-mm\\-dd hh:mm"], ["a", "b &amp; c"]))), (2, bytearray(b"no book")), (3, None)], "id int, content binary")
    found = sorted((tuple(r) for r in sheets.sheet_cells(data).collect()), key=repr)
    assert found == sorted([
        (1, "One", 1, 1, "b & c", None), (1, "One", 1, 2, "1/5/24", None), (1, "One", 1, 3, "12.35%", None), (1, "One", 1, 4, "TRUE", None), (1, "One", 1, 5, "3.1", None),
        (1, "One", 2, 1, "2024-01-05 18:00", None), (1, "One", 2, 2, "in", None), (1, "One", 2, 4, "#N/A", None), (1, "Two", 2, 28, "7", None), (2, None, None, None, None, "PARSE_FAILED"),
    ], key=repr)
    assert files.parse_xlsx(book(rows, ["0"], ["a", "b"])).split("\n")[:3] == ["【工作表：One】", "第1行第1列：b", "第1行第2列：1/5/24"]


@pytest.mark.parametrize("x,code,text", [
    (1234567.891, "#,##0.00", "1,234,567.89"), (0.5, "0%", "50%"), (2.5, "0", "3"), (-3.5, "0.0;(0.0)", "(3.5)"), (1e15, "General", "1E+15"), (0.1 + 0.2, "General", "0.3"), (12, '0"kg"', "12kg"), (5, "[Red]0.0", "5.0"),
    (45296.5, "h:mm AM/PM", "12:00 PM"), (45296.0, "d-mmm-yy", "5-Jan-24"), (45296.26, "mm:ss", "14:24"), (59, "m/d/yyyy", "2/28/1900"), (61, "m/d/yyyy", "3/1/1900"), (-1, "m/d/yy", "-1"), (7, "@", "7"), (1.005, "0.00", "1.01"), (3, "yyyy年m月", "1900年1月"),
])
def test_formats(x, code, text):
    assert sheets.shown(x, code) == text


def test_days_since_1904():
    assert next(iter(sheets.cells(book('<row><c r="A1" s="1"><v>0</v></c></row>', extra='<workbookPr date1904="1"/>'))))[3] == "1/1/04"
