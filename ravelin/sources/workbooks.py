"""Workbooks as a data source: a partition for each file, rows parsed as they stream by, only the columns of the schema."""

from __future__ import annotations

import re
import sys
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _elements(stream: BinaryIO, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag, each thrown away when the next one is asked for."""
    above: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if e.tag == MAIN + tag:
            yield e
            if above:
                above[-1].remove(e)


def place_of(reference: str) -> int:
    """The column of a reference such as AB12, from 0."""
    out = 0
    for c in re.match("[A-Z]+", reference)[0]:
        out = 26 * out + ord(c) - 64
    return out - 1


def sheet_rows(file: BinaryIO, wanted: list[str] | None = None) -> Iterator[list[str | None]]:
    """Rows of a workbook's first sheet as texts, under the names in its first row: those of ``wanted`` in its order, or all.

    Cells without a reference stand after the one before them; empty rows are none; a wanted name that the sheet lacks is null throughout.
    """
    with zipfile.ZipFile(file) as z:
        names = z.namelist()
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        if not sheets:
            return
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in _elements(f, "si")]

        def text(c: ElementTree.Element) -> str | None:
            if c.get("t") == "inlineStr":
                return "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
            value = c.findtext(f"{MAIN}v")
            if c.get("t") == "e":
                return None
            return shared[int(value)] if c.get("t") == "s" and value is not None else value

        at: dict[int, int] | None = None  # columns to places in the result
        width = 0
        with z.open(min(sheets, key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))) as f:
            for row in _elements(f, "row"):
                cells, place = [], -1
                for c in row.iter(f"{MAIN}c"):
                    place = place_of(c.get("r")) if c.get("r") else place + 1
                    if at is None or place in at:
                        cells.append((place, c))
                if at is None:
                    head = {p: v for p, c in cells if (v := text(c))}
                    order = list(head.values()) if wanted is None else wanted
                    at = {p: order.index(v) for p, v in head.items() if v in order}
                    width = len(order)
                elif place >= 0:
                    out: list[str | None] = [None] * width
                    for p, c in cells:
                        out[at[p]] = text(c)
                    yield out


def columns_of(rows: list[list[str | None]], schema: StructType) -> pa.RecordBatch:
    """Texts as columns of the schema's types; what is no number is null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def number(v: str | None, whole: bool):
        try:
            return None if v is None else int(float(v)) if whole else float(v)
        except (ValueError, OverflowError):
            return None

    kinds, out = to_arrow_schema(schema), []
    for k, field in enumerate(schema):
        values = [r[k] for r in rows]
        if isinstance(field.dataType, BooleanType):
            values = [None if v is None else v.strip().lower() in ("1", "true") for v in values]
        elif not isinstance(field.dataType, StringType):
            values = [number(v, isinstance(field.dataType, (IntegerType, LongType))) for v in values]
        out.append(pa.array(values, kinds.field(k).type))
    return pa.RecordBatch.from_arrays(out, schema=kinds)


class WorkbookFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder, self.marker, self.each = schema, options["path"], options.get("marker", ""), int(options.get("rows", "10000"))

    def _located(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(re.sub("^file:/+", "/", self.folder))

    def partitions(self) -> list[InputPartition]:
        """A partition for each workbook in the folder's own folders whose name holds the marker."""
        from pyarrow import fs

        own, folder = self._located()
        dirs = sorted(d.path for d in own.get_file_info(fs.FileSelector(folder)) if d.type == fs.FileType.Directory and self.marker in d.base_name)
        found = [f.path for d in dirs for f in own.get_file_info(fs.FileSelector(d)) if f.type == fs.FileType.File and f.extension == "xlsx"]
        return [WorkbookFile(p) for p in sorted(found)] or [WorkbookFile("")]

    def read(self, partition: WorkbookFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        own, _ = self._located()
        wanted = [f.name for f in self.schema if f.name != "path"]
        with own.open_input_file(partition.path) as f:
            waiting: list[list[str | None]] = []
            for row in sheet_rows(f, wanted):
                waiting.append(row)
                if len(waiting) == self.each:
                    yield self.batch(waiting, partition.path)
                    waiting = []
            if waiting:
                yield self.batch(waiting, partition.path)

    def batch(self, rows: list[list[str | None]], path: str) -> pa.RecordBatch:
        at = [f.name for f in self.schema].index("path") if "path" in self.schema.fieldNames() else None
        return columns_of(rows if at is None else [[*r[:at], path, *r[at:]] for r in rows], self.schema)


class Workbooks(DataSource):
    """``spark.read.format("workbooks").schema(...).option("marker", ...).load(folder)``; a column ``path`` gets the file's."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session; its classes travel whole, so planning needs no path to this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Workbooks)
