"""Reading lesson pages, charts and payloads off small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import scalars as S
from gradeloom.operators import build, checks, curriculum, expressions, extract, quality
from gradeloom.sources import sinks, tables

SPANS = "page int, x double, x1 double, y double, size double, font string, text string"
BOLD, BODY, SEMI = "Hellix-Bold", "Hellix", "Hellix-SemiBold"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).head()["x"]


@pytest.fixture(scope="module")
def page(spark):
    rows = [
        (50.0, 90.0, 30.0, 11.0, BODY, "a tab"), (50.0, 90.0, 100.0, 11.0, BOLD, "Go"), (91.0, 99.0, 100.2, 11.0, BOLD, "als"), (300.0, 380.0, 100.0, 11.0, BOLD, "Learning Targets"),
        (50.0, 90.0, 120.0, 11.0, BODY, "First one-"), (50.0, 90.0, 134.0, 11.0, BODY, "dimensional"), (95.0, 99.0, 137.0, 11.0, BODY, "y"), (300.0, 340.0, 120.0, 11.0, BODY, "I can."),
        (50.0, 60.0, 150.0, 11.0, BOLD, "1."), (50.0, 130.0, 200.0, 11.0, BOLD, "Ac tivity 1"), (150.0, 190.0, 203.0, 8.2, BODY, "Addressing"), (192.0, 230.0, 203.0, 8.2, BODY, "NY-7.RP.2a, NY-7.RP.2b"),
        (50.0, 130.0, 230.0, 11.0, BOLD, "Studen t Task Statement (continued)"), (50.0, 90.0, 250.0, 11.0, BODY, "Do it."), (500.0, 560.0, 300.0, 9.0, BOLD, "Building On"), (500.0, 520.0, 310.0, 8.0, SEMI, "NY-6.RP.1,"),
        (522.0, 540.0, 310.0, 8.0, SEMI, "MP.4"), (500.0, 560.0, 330.0, 9.0, BOLD, "Addressing"), (500.0, 540.0, 340.0, 8.0, SEMI, "NY-7.EE.4"), (50.0, 90.0, 830.0, 11.0, BODY, "footer"),
    ]
    return extract.body_spans(spark.createDataFrame([(1, *r) for r in rows], SPANS))


def test_headings_and_regions(page):
    heads = {(r["text"], r["kind"]) for r in extract.headings(page, "page").collect()}
    assert heads == {("Goals", "field"), ("Learning Targets", "field"), ("1.", "bold"), ("Activity 1", "kind"), ("Student Task Statement", "field")}
    body = page.where(f"font = '{BODY}' AND size > 10")
    got = extract.prose(extract.regions(body, extract.headings(page, "page"), "page"), "page", "heading")
    assert {r["heading"]: r["text"] for r in got.collect()} == {"Goals": "First one-dimensional y", "Learning Targets": "I can.", "Student Task Statement": "Do it."}


def test_standards_beside_headings(page):
    side = {r["label"]: r["codes"] for r in extract.sidebar_standards(page, "page").collect()}
    assert side == {"Building On": ["MP.4", "NY-6.RP.1"], "Addressing": ["NY-7.EE.4"]}
    inline = extract.inline_standards(page, extract.headings(page, "page"), "page").collect()
    assert [(r["heading"], r["label"], r["codes"]) for r in inline] == [("Activity 1", "Addressing", ["NY-7.RP.2a", "NY-7.RP.2b"])]


def test_fractions_fold_into_their_line(spark):
    spans = [(1, -40.0, -20.0, 10.0, 20.0, 11.0, "Lin"), (1, -15.0, -5.0, 10.0, 20.0, 11.0, "then"), (1, 0.0, 20.0, 10.0, 20.0, 11.0, "ran"), (1, 24.0, 28.0, 5.0, 12.0, 8.0, "3"), (1, 24.0, 28.0, 17.0, 24.0, 8.0, "5"), (1, 40.0, 60.0, 10.0, 20.0, 11.0, "hours"), (1, 61.0, 64.0, 8.0, 13.0, 8.0, "2")]
    df = spark.createDataFrame(spans, "line int, x0 double, x1 double, y0 double, y1 double, size double, text string")
    assert expressions.folded_lines(df, "line").head()["text"] == "Lin then ran (3)/(5) hours^2"


def test_glyph_expressions(spark):
    def text(*rows):
        df = spark.createDataFrame([(1, *r) for r in rows], "id int, kind string, label string, x0 double, x1 double, y0 double, y1 double")
        return expressions.decoded_expressions(df, "id").head()["text"]

    g = lambda label, x, y=0.0: ("glyph", label, x, x + 5.0, y, y + 10.0)
    bar = lambda x0, x1, y=5.0: ("bar", None, x0, x1, y, y + 0.5)
    assert text(g("a", 0.0), g("b", 10.0)) == "a b" and text(g("a", 0.0), g("b", 6.0)) == "ab"
    assert text(g("1", 0.0, -12.0), bar(0.0, 2.5, 0.0), bar(2.5, 5.0, 0.0), g("2", 0.0, 2.0)) == "(1)/(2)"  # tiled bars are one
    assert text(g("x", 0.0), bar(7.0, 11.0), g("1", 13.0)) == "x−1"
    assert text(g("=", 0.0), bar(6.0, 30.0)) == "=____"


def test_scalars(spark):
    assert one(spark, S.test_parts(F.lit("2024-released-items-math-g7.pdf")))["id"] == "g7-2024" and one(spark, S.test_parts(F.lit("g8-2026")))["grade"] == 8
    assert one(spark, S.test_parts(F.lit("nothing")))["id"] is None
    assert one(spark, S.number_list(F.lit("16, 19 and 3"))) == [16, 19, 3] and one(spark, S.digits(F.lit("June 20-24"))) == 2024
    assert one(spark, extract.canonical_kind(F.lit("Cool -down:Optional"))) == "Cool-down: Optional" and one(spark, extract.canonical_kind(F.lit("Warm"))) is None
    r = one(spark, extract.repaired_code(F.lit(" NY-NY-7.RP.2a")))
    assert (r["code"], r["era"]) == ("NY-7.RP.2a", "nextgen") and "repeated" in r["repair"] and one(spark, extract.repaired_code(F.lit("7.RP.A.1")))["era"] == "ccls"
    assert one(spark, extract.statistics(F.lit("0.61"), F.lit("mc")))["p_value"] == 0.61 and one(spark, extract.statistics(F.lit("0.61 .5"), F.lit("mc")))["ok"] is False
    s = one(spark, extract.statistics(F.lit("1.2 0.4"), F.lit("cr")))
    assert (s["avg_points"], s["p_value"], s["ok"]) == (1.2, 0.4, True)
    assert [(c["code"], c["note"]) for c in one(spark, extract.line_codes(F.lit("NY-7.EE.4a (Fluency), 4b")))] == [("NY-7.EE.4a", "Fluency"), ("NY-7.EE.4b", None)]
    assert one(spark, extract.optional_lessons(F.lit("All.")))["all"] is True and one(spark, extract.optional_lessons(F.lit("?"))) is None
    box = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((2.0, 5.0), (4.0, 5.0), (3.0, 5.0))])
    assert one(spark, extract.number_shape(box)) == [0.0, 0.0, 1.0, 0.0, 0.5, 0.0]


def test_pacing_geometry(spark):
    words = [(1, x, 50.0, t) for x, t in ((100.0, "Grade"), (130.0, "6"), (250.0, "Grade"), (280.0, "7"), (400.0, "Grade"), (430.0, "8"))] + [(1, 20.0, 60.0 + 10 * i, "week") for i in range(35)]
    words += [(2, 100.0, 50.0, "Grade"), (2, 130.0, 50.0, "6")]
    df = spark.createDataFrame(words, "page int, x0 double, y0 double, text string")
    got = {r["grade"]: (r["lo"], r["hi"]) for r in extract.pacing_geometry(df).collect()}
    assert got == {6: (92.0, 242.0), 7: (242.0, 392.0), 8: (392.0, 10_000.0)}
    assert extract.pacing_geometry(df.where("y0 < 400")).count() == 0


def test_section_pages_and_post_test_tables(spark):
    lines = spark.createDataFrame([(p, "The Standards") for p in (2, 10, 11, 13, 20, 21)], "page int, text string")
    assert sorted(r["page"] for r in extract.section_pages(lines, "The Standards").collect()) == [10, 11, 13]
    rows = [(1, 1.0, "Grade 6 Post-Test Standards Assessed in Grade 7"), (1, 2.0, "NY-6.SP.1a,"), (1, 3.0, "1b"), (1, 4.0, "NY-7.SP.1"), (2, 1.0, "Grade 6 Post-Test Standards Assessed in Grade 7"), (2, 2.0, "NY-6.SP.2"), (3, 1.0, "x")]
    got = extract.post_test_tables(spark.createDataFrame(rows, "page int, y double, text string")).collect()
    assert [(r["taught"], r["tested"], r["codes"]) for r in got] == [(6, 7, ["NY-6.SP.2"])]


def test_figures_and_prose(spark):
    rows = [
        ("a.png", "Graph as Answer Choices", "four graphs", "A rises, B falls", True), ("b.png", "Circle", "radius of 3", "the diameter is 3", True), ("c.png", "Circle", "", None, False),
        ("d.png", "Graphs as Answer Choices", "x", "A is up, B down, C flat, D curved", True),
    ]
    df = spark.createDataFrame(rows, "file string, type string, alt string, long_description string, present boolean")
    got = {(r["file"], r["rule"]) for r in quality.violations(df, checks.figures(), "file").collect()}
    assert got == {("a.png", "choices-are-told-apart"), ("b.png", "alt-agrees"), ("c.png", "figure-is-there"), ("c.png", "figure-has-alt")}
    published = spark.createDataFrame([("1", "Whatisx?"), ("2", "other"), ("3", "x")], "id string, bare string")
    drafts = spark.createDataFrame([("1", "What is x?", 0), ("2", "What", 1)], "id string, prose string, holes int")
    assert {(r["key"], r["rule"]) for r in checks.prose_fidelity(published, drafts).collect()} == {("2", "prose-is-the-page's"), ("2", "no-hole-left"), ("3", "draft-behind-it")}


def test_citations_are_certified(spark):
    ev = [(7, "Grade 7", 1, 2, "Using pi", "ask them"), (7, "Grade 7", 1, 2, "using  PI!", "not there"), (7, "Grade 7", 1, 2, "Other", "ask")]
    evidence = spark.createDataFrame(ev, "grade int, course string, unit int, lesson int, activity string, quote string")
    acts = spark.createDataFrame([(7, 1, 2, "Using Pi", 12, "First, ask — them all")], "grade int, unit int, lesson int, name string, page int, body string")
    named, digests = checks.citation_index(evidence, acts)
    assert [(r["activity"], r["page"]) for r in named.collect()] == [("using pi", 12)]
    want = one(spark, S.field_digest(F.lit("Grade 7"), F.lit("2"), F.lit("Using pi"), F.lit("ask them")))
    assert [r["digest"] for r in digests.collect()] == [want]


def test_packets_and_small_reports(spark):
    items = spark.createDataFrame([("S", "i2", 2024, 2, "mc", 0.5, None), ("S", "i1", 2023, 9, "cr", None, "Stem"), ("T", "i3", 2023, 1, "mc", 0.1, "x")], "standard string, id string, year int, item int, type string, p_value double, stem string")
    tier = spark.createDataFrame([("7.1.2", 1, True, False), ("7.9.9", 2, False, False)], "code string, rank int, unit_tag boolean, table_tag boolean")
    lessons = spark.createDataFrame([("7.1.2", "Title", "A", False, "goal")], "code string, title string, section string, optional boolean, goal string")
    acts = spark.createDataFrame([("7.1.2", "Activity 1", "n", 5, "t" * 300), ("7.1.2", "Cool-down", "m", 6, "short")], "code string, kind string, name string, page int, task string")
    p = curriculum.packet("S", items, tier, lessons, acts)
    assert [(r["id"], r["stem"]) for r in p["items"].collect()] == [("i1", "Stem"), ("i2", "(not transcribed)")]
    assert [(r["why"], r["title"]) for r in p["lessons"].collect()] == [("unit guide tag", "Title"), ("lexical only", "(not in the index)")]
    assert [(len(r["task"]), r["assessed"]) for r in p["activities"].collect()] == [(263, False), (5, True)]
    assert curriculum.packet("S", items, tier, lessons, acts, full=True)["activities"].agg(F.max(F.length("task"))).head()[0] == 300
    glyphs = spark.createDataFrame([(1, "a", 9), (2, None, 5), (3, None, 7)], "cluster int, label string, count int")
    assert [r["cluster"] for r in curriculum.glyph_clusters(glyphs).collect()] == [3, 2, 1]
    assert curriculum.first_lessons(spark.range(30), F.col("id")).count() == 12
    assert one(spark, curriculum.document_text(F.lit("a"), F.lit(None), F.array(F.lit("b"), F.lit("c")))) == "a b c"


def test_payload_pieces(spark, tmp_path):
    units = spark.createDataFrame([(6, 1, "Area"), (6, 2, "Ratios"), (6, 9, "Review")], "grade int, unit int, title string")
    pacing = spark.createDataFrame([(6, 1, "AREA", 10, True, False, [3], 1), (6, 2, "Rates", 12, False, False, [], 5), (6, 9, "Review", 0, False, True, [], 33)], "grade int, unit int, title string, days int, mid_unit_assessment boolean, all_optional boolean, optional_lessons array<int>, start_week int")
    u = build.curriculum_units(units, pacing)
    assert [r["unit"] for r in u.where("title_differs").collect()] == [2]
    with pytest.raises(ValueError, match="pacing"):
        build.refused(u, u.where("title_differs").select("grade", "unit"), "pacing titles")
    lessons = spark.createDataFrame([(6, 1, 3), (6, 1, 4), (6, 9, 1), (7, 1, 3)], "grade int, unit int, lesson int")
    assert {(r["grade"], r["unit"], r["lesson"]): r["optional"] for r in build.curriculum_lessons(lessons, u).collect()} == {(6, 1, 3): True, (6, 1, 4): False, (6, 9, 1): True, (7, 1, 3): False}
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    content = spark.createDataFrame([("a", "stem")], "id string, stem string")
    assert {r["id"]: r["transcribed"] for r in build.with_content(items, content).collect()} == {"a": True, "b": False}
    nested = spark.createDataFrame([((1, 2), [(3, 4)])], "s struct<a: int, b: int>, l array<struct<a: int, b: int>>")
    assert build.without_field(build.without_field(nested, "s", "b"), "l", "b").head() == ((1,), [(3,)])
    entries = spark.createDataFrame([(1, True), (2, None), (3, False)], "id int, draft boolean")
    assert sorted(r["id"] for r in build.published(entries).collect()) == [2, 3]
    out = str(tmp_path / "payload.json")
    sinks.write_payload({"items": items}, out, {"built": "2024"})
    assert json.loads(open(out).read()) == {"meta": {"built": "2024"}, "items": [{"id": "a"}, {"id": "b"}]}
    with pytest.raises(ValueError, match="too-long"):
        sinks.write_payload({"x": spark.createDataFrame([("y" * 400,)], "title string")}, str(tmp_path / "no.json"))
    with pytest.raises(ValueError, match="banned"):
        sinks.write_payload({"x": spark.createDataFrame([(1,)], "zeroCredit int")}, str(tmp_path / "no.json"))
    assert not (tmp_path / "no.json").exists()
    page = spark.createDataFrame([('<script id="data" type="application/json">{"items": [{"id": "a", "grade": 6}], "tests": []}</script>',), ("none",)], "html string")
    assert [(r["id"], r["grade"]) for r in tables.payload_table(tables.embedded_payload(page), "items").collect()] == [("a", 6)]
    html = sinks.report_page("A <b>", {"rows": spark.createDataFrame([("x<y", None)], "a string, b string")})
    assert "A &lt;b&gt;" in html and "<td>x&lt;y</td><td></td>" in html


def test_upserts_keep_a_backup(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    backup = sinks.upsert_table(path, spark.createDataFrame([(2, "new"), (3, "c")], "k int, v string"), "k", "20240101")
    rows = lambda p: sorted(map(tuple, spark.read.parquet(p).collect()))
    assert rows(path) == [(1, "a"), (2, "new"), (3, "c")] and rows(backup) == [(1, "a"), (2, "b")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    sinks.write_manifest(tables.file_manifest(spark, str(tmp_path / "f")), str(tmp_path / "m"), kind=F.lit("released"))
    assert spark.read.json(str(tmp_path / "m")).head()["kind"] == "released"
    docs = tmp_path / "docs"
    docs.mkdir()
    for n in (1, 2):
        (docs / f"{n}.json").write_text(json.dumps([{"grade": 6, "unit": n}]))
    got = tables.read_documents(spark, str(docs / "*.json"), tables.PACING)
    assert sorted((r["unit"], r["source_file"][-6:]) for r in got.collect()) == [(1, "1.json"), (2, "2.json")]
    sinks.write_table(spark.range(2), str(tmp_path / "w"), "2024-01-01")
    assert {r["generated"].isoformat() if hasattr(r["generated"], "isoformat") else r["generated"] for r in spark.read.parquet(str(tmp_path / "w")).collect()} == {"2024-01-01"}


def test_regions_grow_over_labels(spark):
    box = "item int, x0 double, y0 double, x1 double, y1 double"
    region = spark.createDataFrame([(1, 100.0, 100.0, 200.0, 200.0)], box)
    labels = spark.createDataFrame([(1, 205.0, 150.0, 215.0, 160.0), (1, 150.0, 205.0, 160.0, 215.0), (1, 400.0, 150.0, 410.0, 160.0)], box)
    prose = spark.createDataFrame([(1, 0.0, 204.0, 500.0, 216.0)], box)
    got = expressions.grown_region(region, labels, prose, "item", reach=10.0).head()
    assert tuple(got) == (1, 100.0, 100.0, 215.0, 200.0)
    words = spark.createDataFrame([(1, 10.0, 0.0, 20.0, 5.04, "a"), (1, 90.0, 0.0, 95.0, 9.0, "b")], "page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r["text"] for r in tables.in_region(tables.words(words), x=(0.0, 50.0)).collect()] == ["a"]
    pages = spark.createDataFrame([(3, "Map to it"), (4, "7.RP.1"), (4, "7.RP.2"), (4, "7.RP.3"), (9, "Map to it")], "page int, text string")
    assert sorted(r["page"] for r in tables.table_pages(pages, "Map to it", r"^\d\.RP").collect()) == [3, 4]


def test_header_bands_go_past_the_driver(spark):
    """Words made of a small file may be many: no side of a join is sent whole."""
    from gradeloom.plans.registry import queries

    df = queries()["header_bands"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
