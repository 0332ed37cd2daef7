"""Workbook scan (S11, S12): a directory of ``.xlsx`` files, one task per workbook.

``binaryFile`` hands each workbook to ``mapInArrow``, which reads the first sheet
with the standard library (``zipfile`` + ``xml.etree``) and streams rows out
in batches, once; cells come out as text (no per-workbook type guessing, D11), date cells as dates. A workbook is
a zip archive that needs random access, so one file is read whole by one task — an
``.xlsx`` sheet is capped at 1,048,576 rows, which bounds that task.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from dataclasses import dataclass
from datetime import datetime, time, timedelta
from itertools import islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import unescape as _xml_unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.operators.columns import make_unique, normalize_names
from sluice.session import staged

CELLS_SCHEMA = "file_path string, row_no long, nth long, cells array<string>"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RNS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REF = re.compile(r"^([A-Z]+)(\d+)$")
_ROW, _CELL, _V, _T = (f"{_NS}{n}" for n in ("row", "c", "v", "t"))
# where the rows of a sheet begin, behind a prefix that its tags may have, and its outermost tag
_SHEET_DATA = re.compile(rb"<([\w.-]+:)?sheetData(?:\s[^<>]*?)?(/)?>")
_WORKSHEET = re.compile(rb"<((?:[\w.-]+:)?worksheet)[\s>]")
# a plain sheet's first tags (no other encoding, the format's own namespace), row begins, row ends and cells, and what
# a parser would read otherwise: line ends, characters it refuses, entities beyond the usual
_PLAIN_HEAD = re.compile(rb"""\s*(?:<\?xml version="1.0"(?: encoding="(?:UTF|utf)-8")?(?: standalone="(?:yes|no)")?\s*\?>)?\s*<worksheet\s[^<>]*\bxmlns="%s"[^<>]*>"""
                         % re.escape(_NS[1:-1].encode()))
_PLAIN = re.compile(r"""(<row r="(\d+)"(?: (?:spans|ht|customHeight|s|customFormat)="[^"<>&]*")?>|</row>|<c r="([A-Z]+)\d+"(?: s="(\d+)")?(?: t="(\w+)")?>"""
                    r"""(?:<v>([^<>]*)</v>|<is><t(?: xml:space="preserve")?>([^<>]*)</t></is>)</c>)""", re.A)
_NOT_PLAIN = re.compile("[\\x00-\\x08\\x0b-\\x1f\ufffe\uffff]|&(?!(?:amp|lt|gt|quot|apos);)")
#: bytes of a sheet that are parsed at once, and those that its rows must begin within
_STRETCH, _HEAD_BYTES = 1 << 18, 1 << 22
BATCH_ROWS = 5000

# Number formats of the file format that show dates or times, and what in a format's
# code is not a date part (quoted text, escaped, padding and repeated characters, colours and conditions).
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_NO_DATE_PART = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]')


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{_NS}t"))


def _first_sheet(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find(f"{_NS}sheets/{_NS}sheet")
    rid = sheet.get(f"{_RNS}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for r in rels:
        if r.get("Id") == rid:
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
    return "xl/worksheets/sheet1.xml"


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell style numbers whose number format shows a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_NS}numFmt")}

    def shows_date(number: int) -> bool:
        if number not in own:
            return number in DATE_FORMATS
        return re.search("[ymdhs]", _NO_DATE_PART.sub("", own[number].split(";")[0]), re.I) is not None
    styles = root.find(f"{_NS}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else ()) if shows_date(int(x.get("numFmtId", 0)))}


def _first_day(z: zipfile.ZipFile) -> datetime:
    """Day 0 of the workbook's serial numbers."""
    props = ET.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}workbookPr")
    return datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)


def date_text(serial: str, first_day: datetime) -> str:
    """A serial number as a date, with a time if it has one, or as a time alone; what is no date stays as it is."""
    try:
        days = float(serial)
        # the format counts a 29 February 1900: days before it lie one later
        shift = 1 if days < 60 and first_day.year == 1899 else 0
        at = first_day + timedelta(days=int(days) + shift, seconds=round((days - int(days)) * 86400, 3))
    except (ValueError, OverflowError):
        return serial
    if days < 1:
        return at.strftime("%H:%M:%S")
    return at.strftime("%Y-%m-%d") if at.time() == time.min else at.isoformat(" ", "milliseconds" if at.microsecond else "seconds")


def _rows_one_by_one(fh):
    for _, el in ET.iterparse(fh):
        if el.tag == _ROW:
            yield el
            el.clear()


def _plain_rows(data: bytes):
    """``[(row number, [(column letters, style, type, value)])]`` of a stretch of rows that holds plain cells and
    nothing else; None if it holds anything more, or anything that a parser would refuse or change."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if _NOT_PLAIN.search(text):
        return None
    tokens = _PLAIN.findall(text)
    if sum([len(x[0]) for x in tokens]) != len(text):
        return None
    rows, cells = [], None
    for _, number, letters, style, kind, value, inline in tokens:
        if letters:
            if cells is None or (value if kind == "inlineStr" else not value):
                return None
            value = value or inline
            if "&" in value:
                value = _xml_unescape(value, {"&quot;": '"', "&apos;": "'"})
            cells.append((letters, style, kind, value))
        elif number:
            if cells is not None:
                return None
            cells = []
            rows.append((int(number), cells))
        elif cells is None:
            return None
        else:
            cells = None
    return rows if cells is None else None


def _sheet_rows(z: zipfile.ZipFile, name: str):
    """The rows of a sheet, as ``row`` elements or as :func:`_plain_rows` gives them. The sheet's text is cut after row
    ends; a stretch that is not plain is parsed at once, below the tags that are open there. Where comments,
    declarations or other forms could hide a row end, rows are parsed one by one."""
    read = 0
    with z.open(name) as fh:
        data, m = b"", None
        while m is None and len(data) < _HEAD_BYTES and (more := fh.read(_STRETCH)):
            data += more
            m = _SHEET_DATA.search(data)
        root = _WORKSHEET.search(data) if m else None
        if root and not m.group(2) and b"<!" not in data[:m.end()]:
            head, prefix = data[:m.end()], m.group(1) or b""
            end, tail = b"</%srow>" % prefix, b"</%ssheetData></%s>" % (prefix, root.group(1))
            plain = not prefix and _PLAIN_HEAD.match(head) is not None
            data, more = data[m.end():], b"-"
            while b"<!" not in data:
                more = more and fh.read(_STRETCH)
                cut = data.rfind(end) + len(end)
                if cut >= len(end):
                    rows = _plain_rows(data[:cut]) if plain else None
                    for row in rows if rows is not None else ET.fromstring(head + data[:cut] + tail).iter(_ROW):
                        read += 1
                        yield row
                    data = data[cut:]
                if not more:
                    yield from ET.fromstring(head + data).iter(_ROW)
                    return
                data += more
    with z.open(name) as fh:
        yield from islice(_rows_one_by_one(fh), read, None)


def iter_sheet_rows(content: bytes):
    """(row number, [cell text or None]) of the first sheet, blank rows skipped; date cells come as dates."""
    z = zipfile.ZipFile(io.BytesIO(content))
    dates, first_day = _date_styles(z), _first_day(z)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for _, el in ET.iterparse(z.open("xl/sharedStrings.xml")):
            if el.tag == f"{_NS}si":
                shared.append(_text(el))
                el.clear()
    places: dict[str, int] = {}     # of column letters

    def place(letters: str) -> int:
        return places[letters] if letters in places else places.setdefault(letters, _col_index(letters))

    def value(kind: str | None, style, text: str | None) -> str | None:
        if kind == "s" and text is not None:
            return shared[int(text)]
        if kind == "b" and text is not None:
            return "True" if text == "1" else "False"
        if text is not None and kind in (None, "", "n") and dates and int(style or 0) in dates:
            return date_text(text, first_day)
        return text

    for row in _sheet_rows(z, _first_sheet(z)):
        vals: dict[int, str | None] = {}
        if isinstance(row, tuple):
            row_no, cells = row
            for letters, style, kind, text in cells:
                vals[places[letters] if letters in places else place(letters)] = text if kind == "inlineStr" else value(kind, style, text)
        else:
            row_no = int(row.get("r", 0) or 0)
            for c in row.iter(_CELL):
                m = _REF.match(c.get("r", ""))
                idx, kind = place(m.group(1)) if m else len(vals), c.get("t")
                if kind == "inlineStr":
                    vals[idx] = _text(c)
                else:
                    v = c.find(_V)
                    vals[idx] = None if v is None else value(kind, c.get("s", 0), v.text)
        if any(vals.values()):
            width = max(vals) + 1
            yield row_no, list(vals.values()) if list(vals) == list(range(width)) else [vals.get(i) for i in range(width)]


def _parse(batches):
    schema = pa.schema([("file_path", pa.string()), ("row_no", pa.int64()), ("nth", pa.int64()), ("cells", pa.list_(pa.string()))])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = enumerate(iter_sheet_rows(content.as_py()))
            while out := list(islice(rows, BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(out), pa.string()), pa.array([r for _, (r, _) in out], pa.int64()),
                    pa.array([n for n, _ in out], pa.int64()), pa.array([c for _, (_, c) in out], pa.list_(pa.string()))], schema=schema)


@dataclass
class Workbooks:
    cells: DataFrame     # (file_path, row_no, nth, cells), parsed once (written)
    status: DataFrame    # (file_path, n_rows, status)  S12
    table: DataFrame     # data rows, each file's cells under its own normalised header
    header: list[str]    # the headers' real names, united


def read_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx", with_source: bool = False) -> Workbooks:
    """All workbooks under ``path``. ``with_source`` adds ``file_path, row_no, ordinal`` to the table's rows:
    ``ordinal`` counts the data rows of all workbooks by path, each in its sheet's order, from the places that
    the parser met them at (no sort of the rows)."""
    from sluice.sources.records import small
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(path))
    cells = staged(files.select("path", "content").mapInArrow(_parse, CELLS_SCHEMA), "cells")
    first = cells.groupBy("file_path").agg(F.min_by(F.struct("row_no", "cells"), "nth").alias("head"), F.count(F.lit(1)).alias("n"),
                                           F.max(F.size("cells")).alias("width"))
    # the listing decides which files there are: a workbook without a row has no cells
    status = (files.select(F.col("path").alias("file_path")).join(first, "file_path", "left")
              .select("file_path", F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)).cast("bigint").alias("n_rows"),
                      F.when(F.coalesce("n", F.lit(0)) <= 1, F.lit("empty"))
                      .when(F.size(F.filter("head.cells", lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")) == 0,
                            F.lit("blank header"))
                      .otherwise(F.lit("ok")).alias("status")))
    # as wide as the file's widest row, so that no cell lies beyond its header
    first = first.select("file_path", "n", F.concat(
        F.transform("head.cells", lambda x: F.coalesce(x, F.lit(""))),
        F.array_repeat(F.lit(""), F.col("width") - F.size("head.cells"))).alias("header"))
    kinds = first.groupBy("header").agg(F.min("file_path").alias("at")).orderBy("at").collect()
    named = [(list(k["header"]), make_unique(normalize_names(list(k["header"])))) for k in kinds]
    real: dict[str, str] = {}
    for header, names in named:
        for n, h in zip(names, header):
            real.setdefault(n, h)
    if not named:
        return Workbooks(cells, status, cells.select(), [])
    # a row per distinct header: where it has each of the united columns
    where = spark.createDataFrame([(h, [n.index(c) if c in n else None for c in real]) for h, n in named],
                                  "header array<string>, place array<int>")
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    # a row per workbook
    placed = staged(first.join(F.broadcast(where), "header").select(
        "file_path", "place", F.coalesce(F.sum(F.col("n") - 1).over(before), F.lit(0)).alias("offset")), "workbooks")
    data = cells.where("nth > 0").join(small(placed), "file_path").withColumn("ordinal", F.col("offset") + F.col("nth"))
    table = data.select(*[F.get("cells", F.get("place", F.lit(i))).alias(n) for i, n in enumerate(real)],
                        *(["file_path", "row_no", "ordinal"] if with_source else []))
    return Workbooks(cells, status, table, list(real.values()))
