"""Date cells of workbooks, rows in sheet order, workbooks without rows."""
import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluice.sources.workbook import date_text, iter_sheet_rows, read_workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(rows, formats=(), own=(), date1904=False):
    """A sheet whose cells are text, numbers or (number, style): style i shows number format ``formats[i]``."""
    body = []
    for r, row in rows:
        cells = []
        for i, v in enumerate(row):
            at = f"{chr(65 + i)}{r}"
            if isinstance(v, str):
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, tuple):
                cells.append(f'<c r="{at}" s="{v[1]}"><v>{v[0]}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   f'<workbookPr date1904="{int(date1904)}"/><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="r1" Type="x" Target="worksheets/sheet1.xml"/></Relationships>')
        if formats:
            own_xml = "".join(f'<numFmt numFmtId="{n}" formatCode="{c}"/>' for n, c in own)
            z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts>{own_xml}</numFmts><cellXfs>'
                       + "".join(f'<xf numFmtId="{n}"/>' for n in formats) + "</cellXfs></styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {MAIN}><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


@pytest.mark.parametrize("serial,text", [("45296", "2024-01-05"), ("45296.5", "2024-01-05 12:00:00"), ("1", "1900-01-01"), ("59", "1900-02-28"),
                                         ("61", "1900-03-01"), ("0.25", "06:00:00"), ("45296.000011574", "2024-01-05 00:00:01"), ("x", "x")])
def test_serial_numbers(serial, text):
    assert date_text(serial, datetime(1899, 12, 30)) == text


def test_only_date_styles_are_dates():
    own = [(164, "yyyy\\-mm\\-dd hh:mm"), (165, "0.00&quot;days&quot;"), (166, "[Red]0"), (167, "d. mmm")]
    data = workbook([(1, ["a", "b", "c", "d", "e", "f"]), (3, [(45296, 0), (45296, 1), (45296.25, 2), (45296, 3), (45296, 4), (45296, 5)])],
                    [0, 14, 164, 165, 166, 167], own)
    assert list(iter_sheet_rows(data))[1] == (3, ["45296", "2024-01-05", "2024-01-05 06:00:00", "45296", "45296", "2024-01-05"])
    late = workbook([(1, ["a"]), (2, [(0, 0)]), (3, [(43834, 0)])], [14], date1904=True)
    assert [c for _, c in iter_sheet_rows(late)] == [["a"], ["00:00:00"], ["2024-01-05"]]


def test_rows_keep_sheet_order_over_all_workbooks(spark, tmp_path):
    for i in range(3):
        rows = [(2, ["k", "day"])] + [(3 * r + 4, [str(100 * i + r), (45296 + r, 0)]) for r in range(20 * i)]
        (tmp_path / f"{i}.xlsx").write_bytes(workbook(rows, [14]))
    (tmp_path / "none.xlsx").write_bytes(workbook([]))
    books = read_workbooks(spark, str(tmp_path), with_source=True)
    got = books.table.orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(1, 61))
    assert [r["k"] for r in got] == [str(100 + r) for r in range(20)] + [str(200 + r) for r in range(40)]
    assert got[0]["day"] == "2024-01-05" and got[0]["row_no"] == 4
    assert books.table.agg(F.min(F.col("day").cast("date"))).first()[0].isoformat() == "2024-01-05"
    status = {r["file_path"][-9:]: r["status"] for r in books.status.collect()}
    assert status[next(k for k in status if k.endswith("none.xlsx"))] == "empty" and sorted(status.values()) == ["empty", "empty", "ok", "ok"]


@pytest.mark.parametrize("change", [lambda s: s, lambda s: s.replace("</row>", "</row><!-- </row> -->", 2), lambda s: s.replace("</row>", '</row><row r="7"/>', 2),
                                    lambda s: s.replace("<t>t3", "<t><![CDATA[</row>]]>t3"), lambda s: s.replace("<t>t3", "<t>&#65;t3")])
def test_stretches_of_a_sheet_hold_the_same_rows(monkeypatch, change):
    from sluice.sources import workbook as W
    rows = [(1, ["a", "b", "c"])] + [(2 * i, [f"t{i} &amp; ü", (45296 + i, 1), i]) for i in range(1, 60)]
    data, out = workbook(rows, [0, 14]), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as w:
        for n in z.namelist():
            w.writestr(n, change(z.read(n).decode()) if "worksheets" in n else z.read(n))
    want = None
    for stretch in (1 << 18, 700, 90):
        monkeypatch.setattr(W, "_STRETCH", stretch)
        got = list(iter_sheet_rows(out.getvalue()))
        want = want or got
        assert got == want and len(got) == 60 and got[1][0] == 2 and got[1][1][0] == "t1 & ü" and got[1][1][2] == "1"
        assert got[3][1][0].removeprefix("</row>").removeprefix("A") == "t3 & ü"


def test_plain_rows_need_no_parser(monkeypatch):
    from sluice.sinks.chunked import _xlsx_bytes
    from sluice.sources import workbook as W
    data = _xlsx_bytes(["k", "v"], [[str(i), None if i % 3 else "<&> \"x\""] for i in range(500)])
    parsed, parse = [], W.ET.fromstring
    monkeypatch.setattr(W.ET, "fromstring", lambda x: (parsed.append(len(x)), parse(x))[1])
    assert [c for _, c in iter_sheet_rows(data)][1:3] == [["0", "<&> \"x\""], ["1"]]
    assert max(parsed) < 5000
