"""Queries over whole inputs leave nothing out."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import explore, expressions
from gradeloom.plans import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("whole"))


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_terms_of_one_document_are_counted(spark, folder):
    stored(spark, folder, "documents", [(1, "circle square circle"), (2, "square"), (3, None)], "doc_id long, text string")
    got = {(r["term"], r["df"], r["tf"]) for r in QUERIES["term_statistics"](spark, folder).collect()}
    assert got == {("circle", 1, 2), ("square", 2, 2)}


def test_lines_of_all_events_are_joined(spark, folder):
    stored(spark, folder, "events", [(3, 7, "c"), (1, 7, "a"), (2, 7, "b"), (4, 8, "d")], "event_id long, user_id long, event_type string")
    got = {r["user_id"]: r["digest"] for r in QUERIES["joined_lines"](spark, folder).collect()}
    assert got == {7: hashlib.md5(b"a b c").hexdigest(), 8: hashlib.md5(b"d").hexdigest()}


def test_names_of_all_parts_are_compared(spark, folder):
    stored(spark, folder, "part", [(29, "a", "x"), (30, "a", "y"), (58, "b", "z"), (59, "b", "z")], "p_partkey long, p_brand string, p_type string")
    assert [tuple(r) for r in QUERIES["contradictory_names"](spark, folder).collect()] == [("a", "x|y")]


def test_second_tier_has_every_ranked_document(spark, folder):
    stored(spark, folder, "documents", [(i, "circle" if i < 20 else "square") for i in range(25)], "doc_id long, text string")
    stored(spark, folder, "benchmark", [(1, "circle")], "item_id long, text string")
    assert [tuple(r) for r in QUERIES["second_tier_size"](spark, folder).collect()] == [(1, 8)]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_every_row_has_its_place(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i, None if i % 5 == 0 else i % 3 / 2) for i in range(1000)]
        got = explore.placed(spark.createDataFrame(rows, "item int, x double"), F.col("x").desc_nulls_last(), F.col("item").asc()).collect()
        want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        assert [tuple(r) for r in sorted(got, key=lambda r: r["place"])] == [(*r, k + 1) for k, r in enumerate(want)]
        assert explore.placed(spark.createDataFrame([], "item int"), F.col("item").asc()).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_passages_are_found_whatever_stands_before(spark, folder):
    from gradeloom.plans import text_queries

    passage = "the quick brown fox jumps"
    docs = [(1, passage), (2, f'x\t"{passage}" y'), (3, "the quick brown\nfox jumps"), (4, "quick brown fox"), (5, f"({passage}"), (6, "so it is"), (7, None)]
    stored(spark, folder, "documents", docs, "doc_id long, text string")
    stored(spark, folder, "benchmark", [(1, passage), (2, "it is"), (3, None)], "item_id long, text string")
    assert sorted(map(tuple, text_queries._relevant(spark, folder).collect())) == [(1, 1), (1, 2), (1, 5), (2, 6)]


def test_bare_bars_are_minuses(spark):
    glyph = lambda e, x, t: (e, "glyph", t, x, x + 5.0, 0.0, 10.0)
    bar = lambda e, x: (e, "bar", None, x, x + 5.0, 5.0, 5.5)
    rows = [bar(1, 0.0), glyph(1, 6.0, "3"), glyph(2, 6.0, "3"), glyph(3, 0.0, "x"), bar(3, 7.0), glyph(3, 14.0, "1")]
    df = spark.createDataFrame(rows, "id int, kind string, label string, x0 double, x1 double, y0 double, y1 double")
    assert {r["id"]: r["text"] for r in expressions.decoded_expressions(df, "id").collect()} == {1: "\u22123", 2: "3", 3: "x\u22121"}
