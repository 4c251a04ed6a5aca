"""Sheets to report in one call, many sheets at once: what is read, what is refused, what is guarded."""

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import quality, report, responses
from gradeloom.plans import sheets as made

N = 14


def cells(spark, books):
    """books: path -> rows of a sheet."""
    rows = [(p, 0, r, c, None if v is None else str(v)) for p, grid in books.items() for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "path string, sheet int, r int, c int, value string")


@pytest.fixture(scope="module")
def data(spark):
    return made.data(spark)


@pytest.fixture(scope="module")
def test_items(data):
    return {r["item"]: r for r in data.items.where("test = 't0'").collect()}


def head(test_items, *left, shift=0):
    return [*left, *[f"Q{q} ({test_items[(q - 1 + shift) % N + 1]['standard'][3:]})" for q in range(1, N + 1)]]


def answer(it, right):
    if it["type"] == "mc":
        return it["key"] if right else chr(65 + (ord(it["key"]) - 64) % 4)
    return "2" if right else "0"


def student(test_items, name, section, raw):
    """A row with just ``raw`` credits, earned from the first items on; the level is a function of them."""
    row, left = [], raw
    for q in range(1, N + 1):
        worth = test_items[q]["credits"]
        row.append(answer(test_items[q], left >= worth))
        left -= worth if left >= worth else 0
    level = round(1 + 0.19 * (raw - left), 2)
    return [name, section, str(level), *row]


@pytest.fixture(scope="module")
def books(test_items):
    ordinary = [student(test_items, "name", f"60{i % 4}", 1 + i % 18) for i in range(78)]
    ordinary[-1][-2:] = [None, None]
    left = ("Student Name", "Class", "NYS Math")
    named = [student(test_items, f"SMITH, ANN{chr(65 + i)}", f"60{i % 2}", 1 + i % 18) for i in range(24)]
    bare = [row[1:] for row in ordinary[:12]]
    unique = [student(test_items, "name", f"DC{i}", 1 + i) for i in range(12)]
    named_class = [student(test_items, "name", "Smith, Ann", 1 + i) for i in range(12)]
    return {
        "a": [["A title"], [], head(test_items, *left), *ordinary],
        "b": [head(test_items, *left), *named],
        "c": [["note"], ["ELA", "x"], [*head(test_items, "Class", "NYS Math"), "Q15 (6.ZZ.1)"], *[[*r, "A"] for r in bare]],
        "d": [head(test_items, *left, shift=1), *ordinary[:30]],
        "e": [head(test_items, *left), *unique],
        "f": [head(test_items, *left), *named_class],
        "g1": [["nothing", "here"]],
        "g2": [head(test_items, *left)],
        "g3": [[*left, *[f"Q{q} (9.XX.{q})" for q in range(1, N + 1)]], *ordinary[:12]],
        "h": [head(test_items, "Student Name", "Class", "Level"), *ordinary[:12]],
        "i": [head(test_items, *left), *[[*r[:2], str(round(float(r[2]) + 0.1 * (i % 2), 2)), *r[3:]] for i, r in enumerate(ordinary)]],
    }


@pytest.fixture(scope="module")
def got(spark, books, data):
    return report.run(cells(spark, books), data, threshold=0.6)


def status(got):
    return {(r["path"], r["stage"]): (r["usable"], r["why"]) for r in got["status"].collect()}


def test_parsing(spark, books):
    s = responses.parse(cells(spark, books))
    st = {r["path"]: (r["usable"], r["identities"]) for r in s.status.collect()}
    assert st["a"] == (True, False) and st["b"] == (True, True) and st["c"] == (True, False)
    assert not st["g1"][0] and not st["g2"][0] and st["g3"][0]
    n = {r["path"]: r["count"] for r in s.students.groupBy("path").count().collect()}
    assert n["a"] == 78 and n["b"] == 24 and n["c"] == 12 and "g2" not in n
    sections = {r["path"]: r["c"] for r in s.students.groupBy("path").agg(F.countDistinct("section").alias("c")).collect()}
    assert sections["a"] == 4 and sections["b"] == 2 and sections["e"] == 0 and sections["f"] == 0
    values = {(r["student"], r["question"]) for r in s.responses.where("path = 'a'").collect()}
    assert (3 + 77, 13) not in values and (3 + 77, 12) in values and len(values) == 78 * N - 2
    levels = {r["path"] for r in s.levels.collect()}
    assert {"a", "b", "c", "d", "e"} <= levels and "h" not in levels


def test_refusals_are_values(got):
    s = status(got)
    assert s["a", "parse"][0] and s["a", "identify"] == (True, None) and s["a", "curve"][0] and s["a", "gating"][0]
    assert s["d", "identify"][0] is False and "no clear match" in s["d", "identify"][1] and ("d", "curve") not in s
    assert s["g1", "parse"] == (False, "no row of question headers") and s["g2", "parse"][1].startswith("no student rows") and ("g1", "identify") not in s
    assert s["g3", "identify"][0] is False
    assert s["c", "curve"] == (False, "1 scored questions were not released") and s["h", "curve"] == (False, "no level column") == s["h", "gating"]
    assert "not a function" in s["i", "curve"][1]
    assert s["e", "gating"] == (False, "not enough students with a level to band")


def test_identification(got):
    found = {r["path"]: r for r in got["identify"].collect()}
    assert (found["a"]["test"], found["a"]["agree"], found["a"]["published"], found["a"]["unreleased"]) == ("t0", N, N, 0)
    assert (found["c"]["test"], found["c"]["total"], found["c"]["unreleased"]) == ("t0", 15, 1)
    assert [(r["path"], r["item"]) for r in got["unmatched"].collect()] == [("c", 15)]


def test_item_figures(got, books, test_items):
    rows = {(r["path"], r["item"]): r for r in got["items"].collect()}
    grid = books["a"][3:]
    for q in (1, 7, 12, 14):
        it, values = test_items[q], [r[2 + q] for r in grid]
        points = [0 if v is None else (it["credits"] if v == it["key"] else 0) if it["type"] == "mc" else int(v) for v in values]
        r = rows["a", q]
        assert (r["n"], r["answered"], r["omitted"], r["earned"]) == (78, sum(v is not None for v in values), sum(v is None for v in values), sum(points))
        assert abs(r["class_p"] - sum(points) / (it["credits"] * 78)) <= 0.0005  # all students, answered or not
    wrong = [r[2 + 10] for r in grid if r[2 + 10] != test_items[10]["key"]]
    assert rows["a", 10]["top_wrong"] == wrong[0] and rows["a", 10]["top_wrong_count"] == len(wrong)
    o = {r["path"]: r for r in got["overall"].collect()}["a"]
    assert (o["matched"], o["students"], o["total_credits"], o["possible"]) == (N, 78, 18, 18 * 78)


def test_curve_and_gating(got):
    points = {r["raw"]: r["level"] for r in got["curve"].where("path = 'a'").collect()}
    assert all(abs(level - (1 + 0.19 * raw)) < 0.006 for raw, level in points.items())
    cuts = {r["level"]: r for r in got["curve_cuts"].where("path = 'a'").collect()}
    assert cuts[2.0]["raw"] == 6 and not cuts[2.0]["exact"] and cuts[2.0]["below"] == 5
    slopes = {r["band"]: r for r in got["curve_slopes"].where("path = 'a'").collect()}
    assert set(slopes) == {"L1", "L2", "L3", "L4"} and abs(slopes["L2"]["per_credit"] - 0.19) < 0.002
    gates = {r["standard"]: r for r in got["gating"].where("path = 'a'").collect()}
    assert {"gates-L2-L3", "solid"} & {r["bucket"] for r in gates.values()}
    assert got["bands"].where("path = 'a'").count() == 4


def test_schedule(got):
    units = got["checkpoint_units"].where("path = 'a'").collect()
    items = got["checkpoint_items"].where("path = 'a'").collect()
    per = {}
    for r in items:
        per.setdefault(r["unit"], []).append(r["id"])
    assert all(len(v) <= 6 and len(set(v)) == len(v) for v in per.values())
    assert {u["unit"]: u["n_items"] for u in units if u["n_items"]} == {u: len(v) for u, v in per.items()}
    placed = {(r["standard"], r["unit"]) for r in got["placement"].where("path = 'a'").collect()}
    assert all((r["standard"], r["unit"]) in placed for r in items)


def test_reading_orders(got):
    lost = [r["credits_lost"] for r in report.ordered(got, "focus").where("path = 'a'").collect()]
    assert lost == sorted(lost, reverse=True)
    gaps = [1.0 if r["gap"] is None else r["gap"] for r in report.ordered(got, "items").where("path = 'a'").collect()]
    assert gaps == sorted(gaps)


def test_guard(spark, got):
    report.guarded(got)
    leaks = [
        spark.createDataFrame([((["SMITH, JOHN"],),)], "a struct<b: array<string>>"), spark.createDataFrame([({"k": "123456789"},)], "a map<string, string>"), spark.createDataFrame([("LI, AN",)], "t string"),
        spark.createDataFrame([("DC2024JF1",)], "section string"), spark.createDataFrame([({"plByStudent": 1},)], "a map<string, int>"),
    ]
    for df in leaks:
        with pytest.raises(ValueError, match="identities"):
            quality.assert_private(df)
    for name in ("perStudent", "plByStudent", "raw_by_student", "roster", "students_", "pctCorrect", "uid", "pl", "studentName"):
        with pytest.raises(ValueError, match="banned"):
            quality.assert_private(spark.createDataFrame([((1,),)], f"a struct<{name}: int>"))
    quality.assert_private(spark.createDataFrame([("DEF, GHI", 3)], "lesson_title string, students int"))
    long = spark.createDataFrame([("x" * 301, "y" * 999)], "title string, notes string")
    assert [r["column"] for r in quality.identity_findings(long, cap=quality.LONGEST_TEXT, uncapped=quality.LONG_TEXTS).collect()] == ["title"]


def test_other_keys_and_no_sheets(spark, books, data):
    one = cells(spark, {"a": books["a"]}).selectExpr("'x' as school", "path", "r", "c", "value")
    got = report.run(one, data, "school", "path")
    assert [(r["school"], r["test"]) for r in got["identify"].collect()] == [("x", "t0")]
    none = report.run(cells(spark, {"a": books["a"]}).where("false"), data)
    assert none["status"].count() == 0 and none["items"].count() == 0


def test_close_frees_what_a_report_stored(spark, data):
    import os

    other = report.run(cells(spark, {"b": [["x"]]}), data)
    made_ = report.run(cells(spark, {"a": [["x"]]}), data)
    paths = [p.removeprefix("file://") for p in made_.stored]
    assert len(paths) > 5 and all(map(os.path.isdir, paths))
    made_.close()
    assert not any(map(os.path.exists, paths)) and not made_.tables
    assert [r["usable"] for r in other["status"].collect()] == [False]  # another report's tables stay
    other.close()
