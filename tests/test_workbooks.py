"""Typed cells, styles, epochs, partitions and even rows of workbooks."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources import files, workbooks

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Styles by number: general, 14 (a date), 46 (a span), own ones.
STYLES = [0, 14, 46, 164, 165, 166, 20]
CODES = {164: 'yyyy\\-mm\\-dd" d"', 165: "0.00[Red]", 166: "[h]:mm"}


def book(path, sheets, shared=(), old=False, styles=True):
    """sheets: name -> XML of its rows."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="{REL}"><workbookPr date1904="{int(old)}"/><bookViews><workbookView activeTab="{len(sheets) - 1}"/></bookViews><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if styles:
            own = "".join(f'<numFmt numFmtId="{k}" formatCode="{v.replace(chr(34), "&quot;")}"/>' for k, v in CODES.items())
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{NS}"><numFmts>{own}</numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs>' + "".join(f'<xf numFmtId="{i}"/>' for i in STYLES) + "</cellXfs></styleSheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">' + "".join(f"<si>{x}</si>" for x in shared) + "</sst>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{NS}"><dimension ref="A1:B2"/><sheetData>{rows}</sheetData></worksheet>')


def cell(at, value=None, kind=None, style=0):
    return f'<c r="{at}" s="{style}"' + (f' t="{kind}"' if kind else "") + ("/>" if value is None else f"><f>1+1</f><v>{value}</v></c>")


def grid(spark, path, **more):
    return {r.sheet: r.grid for r in files.grids(workbooks.read_workbooks(spark, str(path), **more)).collect()}


def test_values_are_those_of_their_formats(spark, tmp_path):
    row = [cell("A1", "45322", style=1), cell("B1", "0.5", style=6), cell("C1", "1.0833333333333333", style=2), cell("D1", "45322.75", style=3), cell("E1", "7", style=4), cell("F1", "7.50"), cell("G1", "1E3"), cell("H1", "1", "b"), cell("I1", "0", "b"), cell("J1", "#DIV/0!", "e"), cell("K1", "a &amp; b", "str"), cell("L1", "0", "s"), cell("M1", "1", "s"), cell("N1", "2024-02-29T10:00:00Z", "d"), cell("O1", "59", style=1), cell("P1", "61", style=1), cell("Q1", "99999999", style=1), cell("R1", style=1), cell("S1", "0.25", style=5), '<c r="T1" t="inlineStr"><is><r><t>in</t></r><rPh><t>x</t></rPh><r><t>line</t></r></is></c>', cell("U1", "-3")]
    book(tmp_path / "a.xlsx", {"S": f'<row r="1">{"".join(row)}</row>'}, ["<t>plain</t>", "<r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh>"])
    want = ["2024-01-31 00:00:00", "12:00:00", "1 day, 2:00:00", "2024-01-31 18:00:00", "7", "7.5", "1000.0", "True", "False", "#DIV/0!", "a & b", "plain", "rich", "2024-02-29 10:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00", "#VALUE!", None, "6:00:00", "inline", "-3"]
    assert grid(spark, tmp_path / "a.xlsx") == {"S": [want]}


def test_old_epoch_and_no_styles(spark, tmp_path):
    rows = f'<row>{cell("A1", "1.5", style=1)}</row>'
    book(tmp_path / "a.xlsx", {"S": rows}, old=True)
    book(tmp_path / "b.xlsx", {"S": rows}, styles=False)
    assert grid(spark, tmp_path / "a.xlsx") == {"S": [["1904-01-02 12:00:00"]]}
    assert grid(spark, tmp_path / "b.xlsx") == {"S": [["1.5"]]}


@pytest.mark.parametrize("number, code, kind", [(0, None, "number"), (14, None, "date"), (46, None, "span"), (165, "yyyy", "date"), (165, '0 "days"', "number"), (165, "[h]:mm", "span"), (165, "[Red]0.0", "number"), (165, "0;yyyy", "number"), (165, "\\d0", "number"), (165, "General", "number"), (165, "[$-409]d mmm", "date")])
def test_kinds(number, code, kind):
    assert workbooks.kind_of(number, code) == kind


def test_rows_are_even_and_a_table_of_them(spark, tmp_path):
    text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = f'<row r="1">{text("A1", "H1")}{text("B1", "H2")}{text("C1", "H3")}</row><row r="2">{text("A2", "x")}</row><row r="4"><c r="D4" s="1"/></row><row r="5">{text("B5", "y")}</row>'
    book(tmp_path / "a.xlsx", {"S": rows})
    g = grid(spark, tmp_path / "a.xlsx")["S"]
    assert g == [["H1", "H2", "H3", None], ["x", None, None, None], [], [None] * 4, [None, "y", None, None]]
    html = spark.createDataFrame([(g,)], "g array<array<string>>").select(T.html_table(F.col("g"))).first()[0]
    assert [line.count("<t") for line in html.replace("\n", "").split("<tr>")[1:]] == [5, 4, 4]  # 4 heads and tbody, 4, 4


def test_short_rows_of_any_grid_are_filled(spark):
    html = spark.createDataFrame([([["a", "b", "c"], ["1"]],), ([["a"], ["1", None, "3"]],), ([[None], [None, None]],)], "g array<array<string>>").select(T.html_table(F.col("g"))).collect()
    assert [r[0].count("<th>") for r in html] == [3, 3, 2] and [r[0].count("<td>") for r in html] == [3, 3, 0]


def test_a_head_may_be_empty(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"S": '<row r="2"><c r="B2"><v>1</v></c></row>'})
    assert grid(spark, tmp_path / "a.xlsx") == {"S": [[None, None], [None, "1"]]}


def test_a_partition_a_sheet_and_sheets_without_cells(spark, tmp_path):
    big = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{a}{i + 1}"><v>{i * 7919 % 10007}</v></c>' for a in "ABCDEFGH") + "</row>" for i in range(5000))
    book(tmp_path / "a.xlsx", {"Uno": big, "Nada": "", "Dos": big})
    book(tmp_path / "b.xlsx", {"Tres": big})
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    (tmp_path / "d.xlsx").write_bytes((tmp_path / "b.xlsx").read_bytes()[:-2000])
    cells = workbooks.read_workbooks(spark, str(tmp_path / "*.xlsx"), together=1000)
    assert cells.rdd.getNumPartitions() == 4  # each is over 1,000 bytes, or stands between two that are
    assert cells.count() == 3 * 40_000
    assert workbooks.read_workbooks(spark, str(tmp_path / "*.xlsx")).rdd.getNumPartitions() < 3
    names = {(r.path.rsplit("/", 1)[-1], r.sheet_no, r.sheet, r.active) for r in workbooks.read_sheets(spark, str(tmp_path / "*.xlsx")).collect()}
    assert names == {("a.xlsx", 0, "Uno", False), ("a.xlsx", 1, "Nada", False), ("a.xlsx", 2, "Dos", True), ("b.xlsx", 0, "Tres", True)}
    got = cells.where("path like '%b.xlsx' and c = 3").orderBy("r").select("v").limit(3).collect()
    assert [r.v for r in got] == ["0", "7919", "5831"]


def test_cells_without_addresses(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"S": "<row><c><v>1</v></c><c><v>2</v></c></row><row><c><v>3</v></c></row>"})
    assert grid(spark, tmp_path / "a.xlsx") == {"S": [["1", "2"], ["3", None]]}


def test_serials():
    epoch = dt.datetime(1899, 12, 30)
    assert workbooks.serial(0.999999999, "date", epoch) == "1900-01-01 00:00:00" and workbooks.serial(float("nan"), "date", epoch) == "#VALUE!"
    assert workbooks.serial(1.5, "span", epoch) == "1 day, 12:00:00"
