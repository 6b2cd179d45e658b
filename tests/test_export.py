import io
import zipfile
from datetime import datetime, timedelta
from xml.sax.saxutils import escape

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from echoloom.sources.export import SliceExport, read_workbooks, repaired, slice_name, workbook_rows

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>%s</sheetData></worksheet>'


def letter(i):
    return chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26)


def workbook(rows, shared=False, bad=b""):
    strings, body = [], ""
    for r, row in enumerate(rows, 1):
        cells = ""
        for i, v in enumerate(row):
            ref = f'{letter(i)}{r}'
            if v is None:
                continue
            if isinstance(v, bool):
                cells += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
            elif isinstance(v, (int, float)):
                cells += f'<c r="{ref}"><v>{v}</v></c>'
            elif shared:
                strings.append(v)
                cells += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
            else:
                cells += f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        body += f'<row r="{r}">{cells}</row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", (SHEET % body).encode().replace(b"BAD", bad))
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst>{''.join(f'<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r></si>' for s in strings)}</sst>")
    return out.getvalue()


@pytest.mark.parametrize("shared", [False, True])
def test_workbook_rows(shared):
    blob = workbook([["id", " name ", None, "ok", "x" * 3], [1, "a<b&c", "nameless", True, None], [None, None, "only nameless"], [2.5, "支架", None, False, ""]], shared)
    assert workbook_rows(blob) == [{"id": "1", "name": "a<b&c", "ok": "true", "xxx": None}, {"id": "2.5", "name": "支架", "ok": "false", "xxx": None}]
    wide = workbook([[f"c{i}" for i in range(30)], list(range(30))])
    assert workbook_rows(wide) == [{f"c{i}": str(i) for i in range(30)}]
    assert workbook_rows(workbook([["id"]])) == [] == workbook_rows(workbook([]))


def test_control_bytes_are_stripped():
    blob = workbook([["id", "text"], [1, "oneBADtwo"]], bad=b"\x00\x0b\x1f\t")
    assert workbook_rows(blob) == [{"id": "1", "text": "one\ttwo"}] and repaired(blob)[1] == 3
    for broken in (b"", b"no zip", blob[: len(blob) // 2]):
        with pytest.raises(zipfile.BadZipFile):
            workbook_rows(broken)


def export(folder, start, end, day_rows, cap):
    """What the export leaves: a file for a window, cut off at ``cap`` rows, then files of its halves."""
    rows, day = [], start
    while day < end:
        rows += day_rows(day)
        day += timedelta(hours=6)
    (folder / slice_name(start, end)).write_bytes(workbook([["id", "at", "text"], *rows[:cap]], bad=b"\x01"))
    if len(rows) >= cap:
        mid = start + (end - start) / 2
        export(folder, start, mid, day_rows, cap)
        export(folder, mid, end, day_rows, cap)


def test_data_source(spark, tmp_path):
    spark.dataSource.register(SliceExport)
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 25)
    busy = lambda t: [[f"{t:%d%H}-{i}", t.isoformat(), "BADtext"] for i in range(9 if t.day == 13 else 1)]
    for a in (datetime(2024, 1, 1), datetime(2024, 1, 11), datetime(2024, 1, 21)):
        export(tmp_path, a, min(end, a + timedelta(days=10)), busy, 50)
    read = lambda **o: spark.read.format("slice_export").options(path=str(tmp_path), start="2024-01-01", end="2024-01-25", days=10, cap=50, **o)
    df = read().load()
    got = [tuple(r) for r in df.collect()]
    assert df.columns == ["id", "at", "text"] and df.rdd.getNumPartitions() == 3
    want = [(f"{t:%d%H}-{i}", t.isoformat(), "text") for t in (start + timedelta(hours=6 * k) for k in range(96)) for i in range(9 if t.day == 13 else 1)]
    assert sorted(got) == sorted(want)
    assert [tuple(r) for r in read().schema("text string, missing string").load().limit(1).collect()] == [("text", None)]
    with pytest.raises(Exception, match="still cut off"):
        read(depth=0).load().collect()
    (tmp_path / slice_name(datetime(2024, 1, 21), end)).unlink()
    with pytest.raises(Exception, match="no export of the slice"):
        read().load().collect()


def test_workbooks_by_a_spark_path(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.xlsx").write_bytes(workbook([["id", "text"], [i, "oneBAD"]], bad=b"\x02"))
    schema = StructType([StructField("id", StringType()), StructField("text", StringType()), StructField("none", StringType())])
    got = read_workbooks(spark, f"file://{tmp_path}", schema)
    assert sorted(map(tuple, got.collect())) == [(str(i), "one", None) for i in range(3)]
