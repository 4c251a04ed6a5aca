"""Words of positioned characters against a plain loop."""

import random
from collections import Counter

from gradeloom.operators import characters as C

CHAR = "page int, x0 double, x1 double, y0 double, c string, font string"


def loop(rows):
    out = {}
    for page in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == page]
        line_of, first = {}, None
        for y in sorted({r[3] for r in mine}):
            if first is None or y - first > 2.0:
                first = y
            line_of[y] = first
        lines = {}
        for r in mine:
            lines.setdefault(line_of[r[3]], []).append(r)
        steps = {}
        for line in lines.values():
            line.sort(key=lambda r: (r[1], r[2], r[4]))
            for a, b in zip(line, line[1:], strict=False):
                if a[5] == b[5] and b[1] > a[1]:
                    steps.setdefault(a[5], Counter())[round(b[1] - a[1], 1)] += 1
        usual = {f: max(n, key=lambda s, n=n: (n[s], -s)) for f, n in steps.items()}
        for y, line in lines.items():
            found, before = [], None
            for r in line:
                blank = not r[4].strip()
                if not blank:
                    if before is None or not before[4].strip() or (r[5] in usual and r[1] - before[2] > 0.35 * usual[r[5]]):
                        found.append("")
                    found[-1] += r[4]
                before = r
            out.update({(page, y, i + 1): t for i, t in enumerate(found)})
    return out


def test_words(spark):
    rng = random.Random(5)
    rows = []
    for page in range(3):
        for line in range(6):
            x, size = 60.0, rng.choice([5.0, 8.0])
            for _ in range(rng.randint(0, 40)):
                c = rng.choice("abcdefé ")
                rows.append((page, x, x + size * 0.9, 100.0 + line * 12 + rng.choice([0.0, 0.1, 1.5]), c, f"Frutiger-{size}"))
                x += size + rng.choice([0.0, 0.0, 0.0, size * 0.8])
    got = C.words(spark.createDataFrame(rows, CHAR).repartition(3), "page")
    assert {(r["page"], r["line"], r["word"]): r["text"] for r in got.collect()} == loop(rows)
    texts = {(r["page"], r["line"]): r["text"] for r in C.line_texts(got, "page").collect()}
    want = {}
    for (page, y, _), t in sorted(loop(rows).items()):
        want.setdefault((page, y), []).append(t)
    assert texts == {k: " ".join(v) for k, v in want.items()}


def test_lines_and_odd_characters(spark):
    rows = [(1, 60.0, 65.0, 10.0, "a", "F"), (1, 70.0, 75.0, 11.9, "b", "F"), (1, 80.0, 85.0, 13.5, "c", "F"), (1, 90.0, 95.0, None, "d", "F"), (2, 60.0, 65.0, 5.0, " ", "F"), (3, 60.0, 65.0, 5.0, "x", "G")]
    df = spark.createDataFrame(rows, CHAR)
    got = {(r["page"], r["line"], r["text"]) for r in C.words(df, "page").collect()}
    assert got == {(1, 10.0, "a"), (1, 10.0, "b"), (1, 13.5, "c"), (3, 5.0, "x")}  # a line's first decides, not the last
    assert C.words(df.limit(0), "page").count() == 0
    from pyspark.sql import functions as F

    assert C.prose_characters(df, "F", F.lit(5.0), F.lit(12.0)).count() == 3
