"""Workbooks (xlsx) as a Python data source: cells with the values that their number formats give them, and sheets.

The driver opens each workbook for its list of sheets only; a partition is a sheet, or several small ones. A task reads its
sheets' XML as a stream, cell by cell. Shared strings are read once a partition and workbook.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.sources.sinks import file_system

CELLS = "path string, sheet_no int, sheet string, active boolean, r int, c int, v string"
SHEETS = "path string, sheet_no int, sheet string, active boolean"
#: Bytes of packed XML that one partition reads of several sheets, and cells of a batch.
TOGETHER, BATCH = 1 << 20, 10_000

#: Built-in number formats of dates, of times of a day and of spans of time.
DATES, TIMES, SPANS = set(range(14, 23)) | set(range(27, 37)) | set(range(50, 59)), {45, 47}, {46}
#: What a format's text says besides dates, and what makes it one of a span.
ASIDE = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!hh?\]|mm?\]|ss?\])[^\]]*\]', re.I)
SPAN = re.compile(r"\[(hh?|mm?|ss?)\]", re.I)


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e) -> str:
    """The text of a string item: its own and that of its runs, without phonetic guides."""
    if _tag(e) == "rPh":
        return ""
    return (e.text or "") if _tag(e) == "t" else "".join(map(_text, e))


def kind_of(number: int, code: str | None) -> str:
    """date, span or number: what a number format makes of a value."""
    if code is None:
        return "span" if number in SPANS else "date" if number in DATES | TIMES else "number"
    first = code.split(";")[0]
    if SPAN.search(first):
        return "span"
    return "date" if re.search("[dmyhs]", ASIDE.sub("", first), re.I) else "number"


def serial(value: float, kind: str, epoch: dt.datetime) -> str:
    """A day number as a date and time, a time alone, or a span; #VALUE! if there is no such day."""
    try:
        if kind == "span":
            span = dt.timedelta(days=value)
            if span.microseconds:
                span = dt.timedelta(seconds=span.total_seconds() // 1, microseconds=round(span.microseconds, -3))
            return str(span)
        day, rest = divmod(value, 1)
        part = dt.timedelta(milliseconds=round(rest * 86_400_000))
        if 0 <= value < 1 and not part.days:
            return str((dt.datetime.min + part).time())
        if 0 < value < 60 and epoch.year == 1899:  # day 60 is a 29 February that 1900 never had
            day += 1
        return str(epoch + dt.timedelta(days=day) + part)
    except (OverflowError, ValueError):
        return "#VALUE!"


def typed(kind: str | None, raw: str | None, own: str | None, style: str, shared: list[str], epoch: dt.datetime) -> str | None:
    """A cell's value in writing: kind is its t, raw its v, own its inline text, style what its number format says."""
    if kind == "inlineStr":
        return own
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return str(bool(int(raw)))
    if kind == "d":
        with contextlib.suppress(ValueError):
            return str(dt.datetime.fromisoformat(raw.removesuffix("Z")))
    if kind in ("str", "e", "d"):
        return raw
    try:
        value = float(raw) if re.search("[.eE]", raw) else int(raw)
    except ValueError:
        return raw
    return str(value) if style == "number" else serial(value, style, epoch)


@contextlib.contextmanager
def _opened(path: str):
    system, place = file_system(path)
    with system.open_input_file(place) as f, zipfile.ZipFile(f) as z:
        yield z


def _load(z, name: str):
    return ElementTree.fromstring(z.read(name))


def _inside(target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


@dataclass
class Sheet:
    path: str
    sheet_no: int
    name: str
    active: bool
    part: str
    size: int
    old_epoch: bool


def sheets_of(path: str) -> list[Sheet]:
    """The sheets of a workbook; none if it can't be read as one."""
    try:
        with _opened(path) as z:
            links = {e.get("Id"): e.get("Target") for e in _load(z, "xl/_rels/workbook.xml.rels")}
            book = _load(z, "xl/workbook.xml")
            chosen = next((int(e.get("activeTab", 0)) for e in book.iter() if _tag(e) == "workbookView"), 0)
            old = any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
            out = []
            for no, s in enumerate(e for e in book.iter() if _tag(e) == "sheet"):
                part = _inside(links[next(v for k, v in s.attrib.items() if k.rsplit("}", 1)[-1] == "id" and "}" in k)])
                out.append(Sheet(path, no, s.get("name"), no == chosen, part, z.getinfo(part).compress_size, old))
            return out
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, pa.ArrowInvalid):
        return []


def _styles(z) -> list[str]:
    """What the number format of each cell style makes of a value."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = _load(z, "xl/styles.xml")
    own = {int(e.get("numFmtId")): e.get("formatCode") for e in root.iter() if _tag(e) == "numFmt"}
    cells = next((e for e in root if _tag(e) == "cellXfs"), ())
    return [kind_of(int(x.get("numFmtId", 0)), own.get(int(x.get("numFmtId", 0)))) for x in cells]


def _shared(z) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _tag(e) == "si":
                out.append(_text(e))
                e.clear()
    return out


def cells_of(z, sheet: Sheet, styles: list[str], shared: list[str]):
    """(row, column, value) of a sheet's cells, numbers from 0, as the XML is read. A cell that has a style only is one
    without a value; cells without an address stand beside the one before."""
    epoch = dt.datetime(1904, 1, 1) if sheet.old_epoch else dt.datetime(1899, 12, 30)
    row, column, rows = -1, -1, None
    with z.open(sheet.part) as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            name = _tag(e)
            if event == "start":
                if name == "sheetData":
                    rows = e
                elif name == "row":
                    row, column = int(e.get("r", row + 2)) - 1, -1
            elif name == "c":
                if e.get("r"):
                    letters, number = re.fullmatch(r"([A-Z]+)(\d+)", e.get("r")).groups()
                    row, column = int(number) - 1, 0
                    for a in letters:
                        column = column * 26 + ord(a) - 64
                    column -= 1
                else:
                    column += 1
                raw = next((x.text for x in e if _tag(x) == "v"), None)
                own = "".join(_text(x) for x in e if _tag(x) == "is")
                s = int(e.get("s", 0))
                yield row, column, typed(e.get("t"), raw, own, styles[s] if s < len(styles) else "number", shared, epoch)
            elif name == "row":
                rows.clear()  # what was read is no longer needed


@dataclass
class Sheets(InputPartition):
    sheets: list

    def __init__(self, sheets: list):
        super().__init__(None)
        self.sheets = sheets


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.what, self.together = json.loads(options["paths"]), options.get("what", "cells"), int(options.get("together", TOGETHER))

    def partitions(self):
        parts, size = [], 0
        for s in (s for p in self.paths for s in sheets_of(p)):
            if not parts or size + s.size > self.together:
                parts.append([])
                size = 0
            parts[-1].append(s)
            size += s.size
        return [Sheets(p) for p in parts]

    def read(self, partition):
        held = [] if not isinstance(partition, Sheets) else partition.sheets
        if self.what == "sheets":
            yield from ((s.path, s.sheet_no, s.name, s.active) for s in held)
            return
        last, styles, shared = None, [], []
        for s in held:
            with _opened(s.path) as z:
                if s.path != last:
                    last, styles, shared = s.path, _styles(z), _shared(z)
                batch = []
                for cell in cells_of(z, s, styles, shared):
                    batch.append(cell)
                    if len(batch) == BATCH:
                        yield self._batch(s, batch)
                        batch = []
                if batch:
                    yield self._batch(s, batch)

    @staticmethod
    def _batch(s: Sheet, cells: list) -> pa.RecordBatch:
        n = len(cells)
        r, c, v = zip(*cells)
        columns = [pa.array([s.path] * n), pa.array([s.sheet_no] * n, pa.int32()), pa.array([s.name] * n), pa.array([s.active] * n), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(v, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in CELLS.split(", ")])


class Workbooks(DataSource):
    @classmethod
    def name(cls):
        return "workbooks"

    def schema(self):
        return SHEETS if self.options.get("what") == "sheets" else CELLS

    def reader(self, schema):
        return WorkbookReader(self.options)


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    from quire import ship

    ship(spark)
    spark.dataSource.register(Workbooks)
    # Spark lists the files, globs and folders included; names only
    found = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    return spark.read.format("workbooks").option("paths", json.dumps(found)).options(**options).load()


def read_workbooks(spark: SparkSession, path: str, together: int = TOGETHER) -> DataFrame:
    """CELLS of all workbooks: numbers from 0, values in writing. Whole numbers are written without a point, truth values
    as True and False, dates as 2024-01-31 00:00:00, times as 12:30:00, spans of time as 1 day, 2:00:00. An unreadable
    workbook has no rows."""
    return _read(spark, path, together=together)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """SHEETS of all workbooks, those without cells included: a table to each."""
    return _read(spark, path, what="sheets")
