"""Traps of rounding, nulls, order and refusals, on small literal tables."""

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import scalars as S
from gradeloom.operators import agreement, analysis, expressions, explore, itemstats, layout, quality, responses


def one(spark, col):
    return spark.range(1).select(col.alias("x")).head()["x"]


@pytest.mark.parametrize(("x", "want"), [(-0.0005, 0.0), (0.0005, 0.001), (0.4995, 0.5), (-0.0015, -0.001), (None, None)])
def test_half_up(spark, x, want):
    assert one(spark, S.half_up(F.lit(x).cast("double"))) == want


@pytest.mark.parametrize(("text", "want"), [("2.5pts", 2.5), (" -3", -3.0), ("abc", None), ("", None), (".5", 0.5), ("1e2x", 100.0)])
def test_leading_number(spark, text, want):
    assert one(spark, S.leading_number(F.lit(text))) == want


def test_stemmer_takes_the_first_suffix_that_leaves_a_stem(spark):
    words = {"circles": "circl", "measuring": "measur", "relations": "relation", "stories": "story", "bus": "bus", "equations": "equation", "explorations": "explor"}
    for w, want in words.items():
        assert one(spark, S.stemmed(F.lit(w))) == want


def test_codes(spark):
    assert one(spark, S.unrepeated_prefix(F.lit("NY-NY-6.RP.1"))) == "NY-6.RP.1"
    assert one(spark, S.undotted_letter(F.lit("6.RP.3.a"))) == "6.RP.3a"
    assert one(spark, S.undotted_letter(F.lit("6.RP.Cluster"))) == "6.RP.Cluster"
    assert one(spark, S.expanded_codes(F.lit("7.RP.2a, 2b, 2c"))) == ["7.RP.2a", "7.RP.2b", "7.RP.2c"]


ITEMS = "item int, standard string, type string, key string, credits int, p_value double, avg_points double"


def test_item_stats(spark):
    items = spark.createDataFrame([(1, "a", "mc", "B", 1, 0.5, None), (2, "a", "cr", None, 2, 0.4, 1.0), (3, "b", "cr", None, 2, None, None)], ITEMS)
    r = spark.createDataFrame([(s, i, v) for s, vs in {1: "b 2 x", 2: "A 1pt 0", 3: ". . 2"}.items() for i, v in zip((1, 2, 3), [None if x == "." else x for x in vs.split()])], "student int, item int, value string")
    got = {x["item"]: x for x in itemstats.item_stats(r, items).collect()}
    assert (got[1]["answered"], got[1]["omitted"], got[1]["correct"], got[1]["class_p"], got[1]["gap"]) == (2, 1, 1, 0.333, -0.167)
    assert (got[2]["answered"], got[2]["earned"], got[2]["full_credit"], got[2]["state_p"]) == (2, 3.0, 1, 0.5)
    # a text that is no number is omitted; a null population rate gives no gap
    assert (got[3]["answered"], got[3]["zero_credit"], got[3]["state_p"], got[3]["gap"]) == (2, 1, None, None)
    roll = {x["standard"]: x for x in itemstats.rollup(itemstats.item_stats(r, items), "standard").collect()}
    assert roll["b"]["state_p"] == 0.0 and roll["b"]["possible"] == 6


def points(spark, pairs):
    return analysis.curve_points(spark.createDataFrame([(i, r, v) for i, (r, v) in enumerate(pairs)], "student int, raw int, level double"))


def test_curve(spark):
    good = points(spark, [(1, 1.5), (3, 1.9), (5, 2.5), (6, 3.0), (7, 3.5), (9, 4.5), (5, 2.503)])
    assert analysis.curve_status(good).head()["usable"]
    cuts = {c["cut"]: c for c in analysis.curve_cuts(good).collect()}
    assert (cuts[2.0]["raw"], cuts[2.0]["exact"], cuts[2.0]["below"]) == (5, False, 3) and cuts[3.0]["exact"] and cuts[3.0]["raw"] == 6
    slopes = {s["band"]: (s["per_credit"], s["segments"]) for s in analysis.curve_slopes(good).collect()}
    assert slopes == {"L1": (0.2, 1), "L3": (0.5, 1)}
    assert sorted(r["raw"] for r in analysis.unobserved(good, 10).collect()) == [2, 4, 8, 10]
    asks = spark.createDataFrame([(1.0, 3.999), (2.5, 3.0)], "from_level double, to_level double")
    assert sorted((r["from_raw"], r["to_raw"], r["credits"]) for r in analysis.credits_to_reach(good, asks).collect()) == [(1, 9, 8), (5, 7, 2)]
    assert analysis.curve_status(points(spark, [(1, 1.0)])).head()["why"] == "too few distinct raw scores"
    bad = analysis.curve_status(points(spark, [(i, 1.0 + i / 10) for i in range(7)] + [(3, 2.9), (9, 1.0)])).head()
    assert bad["conflicts"] == 2 and not bad["usable"]


def test_gating_buckets(spark):
    rows = [(0.7, 0.7, 0.7, 0.7, "solid"), (0.1, 0.2, 0.3, 0.5, "weak-for-all"), (0.5, 0.6, 0.7, 0.8, "gates-L1-L2"), (0.1, 0.5, 0.6, 0.9, "gates-L2-L3"), (0.1, 0.2, 0.3, 0.6, "gates-L3-L4"), (0.7, 0.5, 0.5, 0.5, "mixed"), (None, 0.5, 0.6, 0.9, "gates-L2-L3")]
    df = spark.createDataFrame(rows, "L1 double, L2 double, L3 double, L4 double, want string")
    assert df.where(analysis.gating_bucket() != F.col("want")).count() == 0


def greedy(gates, supply, cap=analysis.CHECKPOINT_CAP):
    """The schedule as a loop: units one by one, standards by credits lost, a running cap."""
    ranked = sorted(gates, key=lambda g: (-g[2], g[1]))
    top = {g[1] for g in ranked[: max(1, -(-len(ranked) // 3))]}
    want = {}
    for unit in {g[0] for g in gates}:
        picked = 0
        for _, std, _ in sorted((g for g in gates if g[0] == unit), key=lambda g: (-g[2], g[1])):
            w = max(0, min(2 if std in top else 1, cap - picked))
            want[std] = w
            picked += min(w, supply[std])
    return want


def test_checkpoints_are_the_greedy_schedule(spark):
    import random

    rng = random.Random(4)
    for _ in range(3):
        gates = [(rng.randint(1, 3), f"s{i:02d}", float(rng.randint(0, 5))) for i in range(rng.randint(1, 30))]
        supply = {g[1]: rng.randint(0, 3) for g in gates}
        df = spark.createDataFrame([(*g, supply[g[1]]) for g in gates], "unit int, standard string, credits_lost double, available int")
        got = {r["standard"]: r["want"] for r in analysis.checkpoint_wants(df).collect()}
        assert got == greedy(gates, supply)


def test_identify_needs_all_conditions(spark):
    published = spark.createDataFrame([(t, i, f"{t}{i}" if i % 4 else "x") for t in ("A", "B") for i in range(1, 31)], "test string, item int, code string")
    heads = lambda f: spark.createDataFrame([(i, f(i)) for i in range(1, 31)], "item int, code string")
    win = analysis.identify(heads(lambda i: f"A{i}" if i % 4 else "x"), published).where("rank = 1").head()
    assert (win["test"], win["agree"], win["accepted"]) == ("A", 30, True)
    lost = analysis.identify(heads(lambda i: "x"), published).where("rank = 1").head()
    assert not lost["accepted"]


def test_markup_reads_as_text(spark):
    frac = lambda a, b: f'<span class="frac"><span>{a}</span><span>{b}</span></span>'
    cases = {
        "x + " + frac(1, 2): "x + (1)/(2)", frac(frac(1, 2), frac("x<sup>2</sup>", "<i>y</i>")): "((1)/(2))/((x^2)/(y))",
        '<span class="radical"><span class="radicand">1.44</span></span>': "\u221a(1.44)", '<span class="segment">DF</span>': "segment DF", '<span class="repeat">3</span>': "3-repeating",
        "a<sub>1</sub> &le; b &ge; c &minus; d &divide; e &lt;&amp;gt;": "a_1 \u2264 b \u2265 c \u2212 d \u00f7 e <&gt;", "<p>a</p><br/>b <div class='x'>c</div>": "a b c",
        frac(frac(frac(frac(1, 2), 3), 4), 5): "((((1)/(2))/(3))/(4))/(5)", '<span class="math">x<sup>n</sup></span>': "x^n", None: "", "&quot;": "&quot;",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, h string")
    got = {r["i"]: r["t"] for r in df.select("i", S.plain_markup(F.col("h")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_bare_prose_and_balance(spark):
    inner = '<span class="math">x <span class="frac"><span>1</span><span>2</span></span></span>'
    cases = {f"What is {inner} more?": "Whatismore?", "a <span>b</span> \u27e6?\u27e7 &le; c": "ab\u2264c", '<span class="math">never closes': "", None: ""}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, h string")
    got = {r["i"]: r["t"] for r in df.select("i", expressions.bare_prose(F.col("h")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    tags = {"<b>x</b>": True, "<b>x": False, "</b><b>": False, "<br><img src='x'>": True, "<br/>": False, "<i><b></i></b>": True, "": True, None: True, "<x/>": True, "a < b": True}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(tags)], "i int, h string")
    got = {r["i"]: r["t"] for r in df.select("i", expressions.balanced(F.col("h")).alias("t")).collect()}
    assert [got[i] for i in range(len(tags))] == list(tags.values())


def test_quality_and_privacy(spark):
    df = spark.createDataFrame([(1, "ok", 5), (2, None, 50)], "id int, name2 string, n int")
    rules = [quality.Rule("small", F.col("n") > 10), quality.Rule("named", F.col("name2").isNull(), "warn"), quality.Rule("never", F.lit(True), applies=F.lit(False))]
    assert {(r["id"], r["rule"]) for r in quality.violations(df, rules, "id").collect()} == {(2, "small"), (2, "named")}
    assert {r["rule"]: r["status"] for r in quality.outcomes(df, rules).collect()} == {"small": "fail", "named": "warn", "never": "skip"}
    quality.assert_private(df)
    with pytest.raises(ValueError, match="identifier"):
        quality.assert_private(spark.createDataFrame([("id 123456789",)], "t string"))
    with pytest.raises(ValueError, match="surname"):
        quality.assert_private(spark.createDataFrame([("DOE, JANE",)], "t string"))
    quality.assert_private(spark.createDataFrame([("DOE, JANE",)], "t string"), exempt=("t",))
    nested = spark.createDataFrame([(([("x",)],),)], "a struct<list: array<struct<osis: string>>>")
    assert quality.banned_fields(nested) == ["a.list[].osis"]
    with pytest.raises(ValueError, match="banned"):
        quality.assert_private(nested)


def test_layout_small(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 14.9), (3, 99.0)], "id int, y double")
    b = spark.createDataFrame([(7, 9.0), (8, 15.0), (9, 5.0)], "right_id int, y2 double")
    got = {r["id"]: (r["right_id"], round(r["distance"], 3)) for r in layout.nearest(a, b, "y", "y2", within=12).collect()}
    assert got == {1: (7, 1.0), 2: (8, 0.1)}
    w = spark.createDataFrame([(1, 5.0, 9.0, "b"), (1, 5.0, 1.0, "a"), (1, 6.0, 0.0, "c")], "page int, y double, x double, text string")
    assert {r["text"] for r in layout.word_rows(w).collect()} == {"a b", "c"}


def test_expressions(spark):
    g = [("1", "glyph", 0.0, 0.0, 5.0, 4.0), ("2", "glyph", 0.0, 6.0, 5.0, 10.0), ("", "bar", -1.0, 4.8, 6.0, 5.2), ("x", "glyph", 8.0, 3.0, 12.0, 8.0)]
    df = spark.createDataFrame([(1, *r) for r in g], "id int, label string, kind string, x0 double, y0 double, x1 double, y1 double")
    assert expressions.decoded_expressions(df, "id").head()["text"] == "(1)/(2)x"
    lines = expressions.growing_lines(spark.createDataFrame([(1, 0.0, 5.0), (1, 4.0, 9.0), (1, 8.0, 12.0), (1, 20.0, 22.0)], "id int, y0 double, y1 double"), "id")
    assert sorted(r["line"] for r in lines.collect()) == [0, 0, 0, 1]


def test_fuzzy_sections(spark):
    asked = spark.createDataFrame([(1, 7, "Solving equations with ratios"), (2, 7, "something else entirely")], "ask_id int, grade int, title string")
    sections = spark.createDataFrame([(10, 7, "Solving Equations with Ratios"), (11, 7, "Angles"), (12, 8, "Solving equations")], "section_id int, grade int, heading string")
    assert {r["ask_id"]: r["section_id"] for r in agreement.fuzzy_sections(asked, sections, "grade").collect()} == {1: 10, 2: None}


def test_facets(spark):
    df = spark.createDataFrame([(1, ["3"]), (2, []), (3, None), (4, ["4", "3"])], "id int, units array<string>")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(explore.faceted(df, units=["3"])) == [1, 4] and ids(explore.faceted(df, units=[None])) == [2, 3]
    assert ids(explore.faceted(df, units=["4", None])) == [2, 3, 4] and ids(explore.faceted(df, units=[])) == [1, 2, 3, 4]


def test_privacy_beside_accented_letters(spark):
    """Words end as in SQL, where only ASCII letters make words."""
    import duckdb

    texts = ["CIÓNTAJA,HMSAO", "Ó123456789", "123456789é", "DOE, JANEß", "aDOE, JANE", "_DOE, JANE", "DOE, JANE_", "1234567890", "x123456789", "DOE, JANEx", "(123456789)", "٣123456789"]
    found = {r["kind"]: r["n"] for r in quality.identity_findings(spark.createDataFrame([(t,) for t in texts], "t string")).collect()}
    c = duckdb.connect()
    c.execute("create table v(t varchar)")
    c.executemany("insert into v values (?)", [(t,) for t in texts])
    n = lambda p: len(c.execute("select t from v where regexp_matches(t, ?)", [p]).fetchall())
    assert found == {"identifier": n(r"\b\d{9}\b"), "surname-forename": n(r"\b[A-Z]{2,}, ?[A-Z]{2,}\b")} == {"identifier": 4, "surname-forename": 2}
