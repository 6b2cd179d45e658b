"""Exports of a window as a Python data source: workbooks of planned slices, repaired, halved where they were cut off."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .slices import CAP, DEPTH, slices

#: Fixed value: bytes that no XML text may hold, and some exports do.
BAD_BYTES = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")
STAMP = "%Y%m%dT%H%M%S"


def repaired(blob: bytes) -> tuple[dict[str, bytes], int]:
    """The XML members of a workbook without bytes that XML forbids, and how many bytes went."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        raw = {n: z.read(n) for n in z.namelist() if n.endswith((".xml", ".rels"))}
    clean = {n: BAD_BYTES.sub(b"", x) for n, x in raw.items()}
    return clean, sum(len(raw[n]) - len(clean[n]) for n in raw)


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t") or t.tag == "t")


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook_rows(blob: bytes) -> list[dict[str, str | None]]:
    """Rows of a workbook's first sheet by the names in its header row, all as text; columns without a name are left out.

    Cells may hold shared or inline strings, truth values and numbers, which stay as they are written. Rows without any
    value are none. What is no workbook raises zipfile.BadZipFile.
    """
    members, _ = repaired(blob)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in members:
        shared = [_text(si) for si in ElementTree.fromstring(members["xl/sharedStrings.xml"]) if si.tag.endswith("si")]
    sheets = sorted((n for n in members if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if not sheets:
        raise zipfile.BadZipFile("a workbook without sheets")
    header: dict[int, str] | None = None
    out = []
    for row in ElementTree.fromstring(members[sheets[0]]).iter():
        if not row.tag.endswith("row"):
            continue
        values: dict[int, str] = {}
        at = 0
        for cell in row:
            at = _column(cell.get("r")) if cell.get("r") else at
            kind, raw = cell.get("t", "n"), next((x.text for x in cell if x.tag.endswith("v")), None)
            value = _text(cell) if kind == "inlineStr" else raw
            if kind == "s" and raw is not None:
                value = shared[int(raw)]
            elif kind == "b" and raw is not None:
                value = "true" if raw == "1" else "false"
            if value not in (None, ""):
                values[at] = value
            at += 1
        if header is None:
            header = {i: v.strip() for i, v in values.items() if v.strip()}
        elif any(i in values for i in header):
            out.append({name: values.get(i) for i, name in header.items()})
    return out


def slice_name(a: datetime, b: datetime) -> str:
    return f"{a.strftime(STAMP)}-{b.strftime(STAMP)}.xlsx"


class Slice(InputPartition):
    """A planned slice, half-open."""

    def __init__(self, start: datetime, end: datetime) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


class SliceReader(DataSourceReader):
    def __init__(self, folder: str, parts: list[tuple[datetime, datetime]], names: list[str], cap: int, depth: int) -> None:
        self.folder, self.parts, self.names, self.cap, self.depth = folder, parts, names, cap, depth

    def partitions(self) -> list[Slice]:
        return [Slice(a, b) for a, b in self.parts]

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from self._rows(partition.start, partition.end, 0)

    def _rows(self, a: datetime, b: datetime, level: int) -> Iterator[tuple]:
        path = os.path.join(self.folder, slice_name(a, b))
        if not os.path.exists(path):
            raise FileNotFoundError(f"no export of the slice {a} to {b}: {path}")
        with open(path, "rb") as f:
            rows = workbook_rows(f.read())
        if len(rows) < self.cap:
            for r in rows:
                yield tuple(r.get(n) for n in self.names)
            return
        # As many rows as the export gives at most: it was cut off, and its halves are read instead.
        if level == self.depth:
            raise RuntimeError(f"{a} to {b} is still cut off after {self.depth} halvings")
        mid = a + (b - a) / 2
        yield from self._rows(a, mid, level + 1)
        yield from self._rows(mid, b, level + 1)


class SliceExport(DataSource):
    """``spark.read.format("slice_export")``: the rows of a window from the workbooks that an export left in a folder.

    Options: path (a folder that driver and executors share), start and end (ISO times, half-open), days of a slice, cap
    (rows at which an export is cut off) and depth (halvings at most). A slice is one partition and one file,
    ``<start>-<end>.xlsx``; where it was cut off, its task reads the files of its halves. Columns are those of the given
    schema, or of the first workbook there is, all as text. A missing or unreadable file is an error, as its rows
    would be missing without notice.
    """

    @classmethod
    def name(cls) -> str:
        return "slice_export"

    def _parts(self) -> list[tuple[datetime, datetime]]:
        return slices(datetime.fromisoformat(self.options["start"]), datetime.fromisoformat(self.options["end"]), int(self.options.get("days", "30")))

    def schema(self) -> StructType:
        for a, b in self._parts():
            path = os.path.join(self.options["path"], slice_name(a, b))
            if os.path.exists(path):
                with open(path, "rb") as f:
                    rows = workbook_rows(f.read())
                if rows:
                    return StructType([StructField(n, StringType()) for n in rows[0]])
        raise ValueError("no workbook with rows to take the columns from: give a schema")

    def reader(self, schema: StructType) -> SliceReader:
        return SliceReader(self.options["path"], self._parts(), schema.names, int(self.options.get("cap", CAP)), int(self.options.get("depth", DEPTH)))


def read_workbooks(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All workbooks under a path that only Spark reads, each by one task; columns of text by name. An unreadable one is an error."""
    names = schema.names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for blob in batch.column(0):
                rows = workbook_rows(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], pa.string()) for n in names], names=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, StructType([StructField(n, StringType()) for n in names]))

