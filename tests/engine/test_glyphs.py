"""Observation of shapes and reading of plots against plain loops."""

import random

import pytest

from gradeloom.operators import glyphs as G

SHAPE = "place long, form string, bucket string, points array<double>"


def loop(shapes, most):
    """The clusters as they come: own bucket first, then the nearest, then the first."""
    found, out = [], {}
    for place, form, bucket, points in sorted(shapes):
        near = []
        for c in found:
            if c[1] == form and len(c[3]) == len(points):
                d = sum(abs(a - b) for a, b in zip(points, c[3], strict=True)) / len(points) if points else 0.0
                if d < most:
                    near.append((c[2] != bucket, d, c[0]))
        if near:
            out[place] = min(near)[2]
        else:
            found.append((place, form, bucket, points))
            out[place] = place
    return out


def seen(spark, shapes, most):
    df = spark.createDataFrame(shapes, SHAPE).repartition(4)
    got = {r["place"]: r["cluster"] for r in G.observed(df, most).collect()}
    assert len(got) == len(shapes)
    return got


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 400, 0.3), (2, 400, 0.05), (3, 300, 1.0)])
def test_observed_is_the_loop(spark, seed, n, spread):
    rng = random.Random(seed)
    shapes = [(i, rng.choice(["deg:1", "out:2"]), rng.choice("ab"), [rng.uniform(0, spread) for _ in range(rng.choice([2, 6]))]) for i in rng.sample(range(5000), n)]
    shapes += [(9000 + i, *s[1:]) for i, s in enumerate(rng.sample(shapes, 60))]  # equal ones
    assert seen(spark, shapes, 0.04) == loop(shapes, 0.04)


def test_ten_thousand_shapes_of_one_bucket(spark):
    rng = random.Random(7)
    letters = [[rng.random() for _ in range(8)] for _ in range(25)]
    shapes = [(i, "out:8", "one", [x + rng.gauss(0, 0.008) for x in rng.choice(letters)]) for i in range(10_000)]
    assert seen(spark, shapes, 0.04) == loop(shapes, 0.04)


def test_none_empty_and_equal_shapes(spark):
    assert seen(spark, [(1, "f", "a", [])], 0.04) == {1: 1}
    assert seen(spark, [(2, "f", "a", []), (1, "f", "b", []), (3, "g", "a", [])], 0.04) == {1: 1, 2: 1, 3: 3}
    assert seen(spark, [(i, "f", "a", [0.5, 0.5]) for i in range(50)], 0.04) == dict.fromkeys(range(50), 0)
    assert G.observed(spark.createDataFrame([], SHAPE), 0.04).count() == 0
    n = {r["cluster"]: r["n"] for r in G.clusters(spark.createDataFrame([(1, "f", "a", [0.0]), (2, "f", "a", [0.01]), (3, "f", "a", [1.0])], SHAPE), 0.04).collect()}
    assert n == {1: 2, 3: 1}


DRAWN = "fig int, x0 double, y0 double, x1 double, y1 double, filled boolean"


def plot(fig, dots, step=10.0, half=4, axis=True, skew=0.0):
    out = []
    for i in range(-half, half + 1):
        over = half * step + (8 if axis and i == 0 else 0)
        out.append((fig, 200 + i * step + skew * i * i - 0.2, 300 - over, 200 + i * step + skew * i * i + 0.2, 300 + over, False))
        out.append((fig, 200 - over, 300 + i * step - 0.2, 200 + over, 300 + i * step + 0.2, False))
    return out + [(fig, 198 + x * step, 298 - y * step, 202 + x * step, 302 - y * step, f) for x, y, f in dots]


def test_plotted_points(spark):
    dots = [(1, 2, True), (-3, 0, True), (2, -2, False), (1.4, 1, True), (0, -4, True), (1, 2, True)]
    rows = plot(1, dots) + plot(2, dots, axis=False) + plot(3, dots, step=12.5, half=5) + plot(4, dots, skew=1.5) + plot(5, [])
    rows += [(1, 0.0, 700.0, 600.0, 700.5, False), (1, 20.0, 100.0, 20.5, 160.0, False), (6, 0.0, 0.0, 4.0, 4.0, True)]  # a footer's rule, a stray line, a dot alone
    got = {(r["fig"], r["px"], r["py"]) for r in G.plotted_points(spark.createDataFrame(rows, DRAWN).repartition(3), "fig").collect()}
    want = {(1, 2), (-3, 0), (0, -4)}
    assert got == {(f, *p) for f in (1, 3) for p in want}
    assert G.plotted_points(spark.createDataFrame([], DRAWN), "fig").count() == 0


def test_calibration(spark):
    ticks = [(1, "x", 100.0 + 20 * i, 5.0 * i - 10) for i in range(9)] + [(1, "y", 400.0 - 15 * i, 0.5 * i) for i in range(9)]
    ticks[3] = (1, "x", 160.0, 50.0)  # a label that was read wrongly
    ticks[12] = (1, "y", 355.0, 15.0)
    ticks += [(2, "x", 10.0 * i, float(i)) for i in range(6)]  # without a second axis
    ticks += [(3, "x", 10.0 * i, float(i)) for i in range(6)] + [(3, "y", 10.0 * i, v) for i, v in enumerate([1.0, 9.0, 2.0, 50.0, 3.0, -7.0])]  # no line
    ticks += [(4, "x", 10.0, 1.0), (4, "y", 10.0, 1.0)] + [(5, a, 10.0 * i, 3.0) for a in "xy" for i in range(5)]  # one tick, no slope
    marks = [(f, 7, 130.0, 370.0) for f in range(1, 6)]
    df = spark.createDataFrame(ticks, "fig int, axis string, at double, value double").repartition(3)
    got = [tuple(r) for r in G.marked_values(spark.createDataFrame(marks, "fig int, id int, x double, y double"), df, "fig").collect()]
    assert [(f, i, round(x, 9), round(y, 9)) for f, i, x, y in got] == [(1, 7, -2.5, 1.0)]


def test_the_query_is_the_loop(spark):
    import os

    from gradeloom.plans.drawing_queries import observed_shapes

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the driver's tables are not here")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    want = loop([(r["vec_id"], "out", str(r["label"]), [float(x) for x in r["embedding"][:3]]) for r in rows], 0.06)
    assert {r["place"]: r["cluster"] for r in observed_shapes(spark, d).collect()} == want and len(set(want.values())) < len(want)


def test_plotted_points_go_past_the_driver(spark):
    """Figures made of a small table may be many: no side of a join is sent whole."""
    df = G.plotted_points(spark.createDataFrame([(1, 0.0, 0.0, 0.4, 40.0, False)], DRAWN), "fig")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
