"""Fractions of spans against the sequential loop."""

import random
import re
from collections import Counter

from gradeloom.operators import fractions as R

SPAN = "page int, id int, x double, x1 double, y double, size double, text string"


def loop(spans):
    body = [s for s in spans if 10.0 <= s[5] <= 12.5]
    if not body:
        return []
    n = Counter(round(s[5], 1) for s in body)
    dom = min(n, key=lambda k: (-n[k], k))
    small = [s for s in spans if 0.55 * dom <= s[5] < 10.0]
    used, out = set(), [s[1:] for s in body]
    for bar in sorted(s for s in small if re.match("^_+$", s[6].strip()) and 0.75 * dom <= s[5] <= 0.98 * dom):
        above, below = [], []
        for s in small:
            if s[1] in used or re.match("^_+$", s[6].strip()) or s[3] < bar[2] - 1.0 or s[2] > bar[3] + 1.0 or abs(s[4] - bar[4]) > 14.0:
                continue
            (above if s[4] <= bar[4] + 0.5 else below).append(s)
        if above and below:
            used.update(s[1] for s in above + below)
            text = "/".join(" ".join("".join(s[6] for s in sorted(g, key=lambda s: (s[2], s[1]))).split()) for g in (above, below))
            out.append((bar[1], bar[2], bar[3], bar[4] + 1.5, dom, text))
    return out


def test_against_the_loop(spark):
    rng = random.Random(6)
    spans = []
    for page in range(6):
        for i in range(70):
            x, y = rng.uniform(0, 120), rng.uniform(0, 60)
            size, text = rng.choice([(11.0, "word"), (11.0, "more"), (10.4, "odd"), (9.6, "__"), (9.7, "___"), (8.2, "3"), (8.2, "x 1"), (8.3, "12"), (5.0, "tiny"), (20.0, "Head")])
            spans.append((page, i, x, x + 4.0 * len(text), y, size, text))
    got = R.folded_fractions(spark.createDataFrame(spans, SPAN).repartition(4), "page").collect()
    want = [(p, *s) for p in range(6) for s in loop([s for s in spans if s[0] == p])]
    assert Counter((r["page"], r["id"], r["x"], r["x1"], r["y"], r["size"], r["text"]) for r in got) == Counter(want)
    assert sum("/" in s[-1] for s in want) > 8


def test_odd_pages(spark):
    rows = [(1, 1, 0.0, 9.0, 50.0, 9.6, "__"), (1, 2, 1.0, 5.0, 45.0, 8.2, "1"), (1, 3, 1.0, 5.0, 55.0, 8.2, "2")]  # no body type
    rows += [(2, 1, 0.0, 9.0, 50.0, 11.0, "Lin ran 2"), (2, 2, 10.0, 19.0, 50.0, 9.6, " __ "), (2, 3, 12.0, 15.0, 44.0, 8.2, "3"), (2, 4, 12.0, 15.0, 56.0, 8.2, "5")]
    rows += [(3, 1, 0.0, 9.0, 50.0, 11.0, "Answer"), (3, 2, 10.0, 40.0, 50.0, 9.6, "____"), (3, 3, 12.0, 15.0, 56.0, 8.2, "5"), (4, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SPAN)
    assert sorted((r["page"], r["text"]) for r in R.folded_fractions(df, "page").collect()) == [(2, "3/5"), (2, "Lin ran 2"), (3, "Answer")]
    assert R.folded_fractions(df.limit(0), "page").count() == 0
