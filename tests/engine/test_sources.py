"""Workbooks, stored tables, sinks and streams."""

import datetime
import json
import zipfile

import pytest

from gradeloom.sources import sinks, tables, workbooks
from gradeloom.streaming import events

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, method=zipfile.ZIP_DEFLATED):
    sheet = f"""<worksheet {NS}><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row>
<row r="3"><c r="B3"><v>2.5</v></c><c r="AA3" t="b"><v>1</v></c><c r="AB3" t="str"><v>a&amp;b</v></c></row></sheetData></worksheet>"""
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="One" sheetId="1"/><sheet name="Two" sheetId="2"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><r><t>he</t></r><r><t>ad</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    workbook(tmp_path / "b.xlsx", zipfile.ZIP_STORED)
    got = workbooks.read_workbooks(spark, str(tmp_path), every=True)
    rows = {(r["path"][-6:-5], r["name"], r["r"], r["c"]): (r["value"], r["kind"]) for r in got.collect()}
    for f in "ab":
        assert rows[(f, "One", 0, 0)] == ("head", "string") and rows[(f, "One", 0, 2)] == ("in", "string")
        assert rows[(f, "One", 2, 1)] == ("2.5", "number") and rows[(f, "One", 2, 26)] == ("true", "boolean")
        assert rows[(f, "One", 2, 27)] == ("a&b", "string") and rows[(f, "Two", 0, 0)] == ("7", "number")
    assert workbooks.read_workbooks(spark, str(tmp_path / "a.xlsx")).count() == 5
    with pytest.raises(ValueError, match="not a workbook"):
        list(workbooks.workbook_cells(b"nothing"))
    assert [workbooks.column_index(x) for x in ("A1", "Z9", "AA1", "AB12")] == [0, 25, 26, 27]


def test_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"grade": 6, "unit": 1, "days": [3, 4]}]))
    assert tables.read_json(spark, str(tmp_path / "a.json"), tables.PACING).head()["days"] == [3, 4]
    assert tables.read_json(spark, str(tmp_path / "none.json"), tables.PACING, optional=True).count() == 0
    (tmp_path / "x.csv").write_text('Q,Curriculum Notes\n1,"a, b"\n')
    assert tables.read_csv(spark, str(tmp_path / "x.csv"), notes="notes").head()["notes"] == "a, b"
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "x.csv"), other="zzz")
    old = tables.file_manifest(spark, str(tmp_path / "*.json"))
    new = tables.file_manifest(spark, str(tmp_path / "*.csv"))
    assert sorted(r["status"] for r in tables.manifest_changes(old, new).collect()) == ["added", "removed"]
    assert tables.wanted_sources(spark, ["a", "b"], [6, 7], [2024]).count() == 4


def test_sinks(spark):
    refs = spark.createDataFrame([(1,), (2,)], "k int")
    here = spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    assert [r["k"] for r in sinks.missing_references(refs, here, "k").collect()] == [2]
    with pytest.raises(Exception, match="missing: 2"):
        sinks.copied_references(refs, here, "k").collect()


def test_stream_is_the_batch(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, i % 5, i % 60), i % 3, "abc"[i % 3], i / 2) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = events.tumbling(events.stream(spark, str(tmp_path / "in"), df.schema))
    q = out.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("tumbled").collect()))
    finally:
        q.stop()
    assert got == sorted(map(tuple, events.tumbling(df).collect()))
