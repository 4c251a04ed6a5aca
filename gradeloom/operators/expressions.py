"""Operators whose state doesn't fit relational plans: nested markup, fractions, growing lines.

They run in Arrow batches or on one bounded group (an expression, a page, an item).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.scalars import ENTITIES

#: Elements without a closing tag.
VOID = ("br", "img", "hr", "input", "meta", "link")


def balanced(html: Column) -> Column:
    """Whether no tag closes before one opened, and all that opened close; null is empty.

    Names don't have to match; a void element opens nothing, but ``<br/>`` closes.
    """
    tags = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", ""), F.lit(r"</?[a-zA-Z][^>]*>"), F.lit(0))

    def step(tag: Column) -> Column:
        void = F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)).isin(*VOID)
        return F.when(tag.startswith("</"), -1).when(tag.endswith("/>"), F.when(void, -1).otherwise(0)).when(void, 0).otherwise(1)

    def walk(at: Column, tag: Column) -> Column:
        depth = at["depth"] + step(tag)
        return F.struct(depth.alias("depth"), F.least(at["low"], depth).alias("low"))

    return F.aggregate(tags, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), walk, lambda at: (at["depth"] == 0) & (at["low"] >= 0))


SPAN = re.compile(r"<span[^>]*>|</span>")


def prose_only(html: str | None) -> str:
    """Markup without its maths spans, however deep they nest, without span tags, unread glyphs
    and white space, entities decoded. A maths span that never closes takes the rest."""
    html = html or ""
    out, depth, at = [], 0, 0
    for m in SPAN.finditer(html):
        if depth:
            depth += -1 if m[0] == "</span>" else 1
        else:
            out.append(html[at : m.start()])
            depth = m[0] == '<span class="math">'
        at = m.end()
    if not depth:
        out.append(html[at:])
    text = "".join(out).replace("\u27e6?\u27e7", "")
    for entity, char in (*ENTITIES[4:6], ENTITIES[7], ENTITIES[6], *ENTITIES[:4]):
        text = text.replace(entity, char)
    return re.sub(r"\s+", "", text)


def bare_prose(html: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(prose_only), "string")(html)


def _folded(spans: pd.DataFrame) -> str:
    """Spans of a line as text: a pair stacked over a bar becomes (top)/(bottom), small raised
    spans become exponents."""
    body = spans["size"].mode().iloc[0]
    left = spans.sort_values(["x0", "y0"], kind="stable").to_dict("records")
    base = [s for s in left if s["size"] == body]
    middle = sum((s["y0"] + s["y1"]) / 2 for s in base) / max(len(base), 1)
    out: list[str] = []
    used: set[int] = set()
    for i, s in enumerate(left):
        if i in used:
            continue
        centre = (s["y0"] + s["y1"]) / 2
        mate = next((j for j, t in enumerate(left) if j != i and j not in used and t["x0"] < s["x1"] and s["x0"] < t["x1"] and abs((t["y0"] + t["y1"]) / 2 - centre) > 1), None)
        if mate is not None:
            t = left[mate]
            top, bottom = (s, t) if s["y0"] < t["y0"] else (t, s)
            out.append(f"({top['text']})/({bottom['text']})")
            used.add(mate)
        elif s["size"] < body and centre < middle:
            out.append(f"^{s['text']}")
        else:
            out.append(s["text"])
        used.add(i)
    return re.sub(r"\s+(\^)", r"\1", " ".join(out))


def folded_lines(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys.., text) from spans (x0, y0, x1, y1, size, text): a group is one line of a page."""
    schema = ", ".join(f"`{k}` {spans.schema[k].dataType.simpleString()}" for k in keys) + ", text string"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "text": _folded(pdf)}])

    return spans.groupBy(*keys).applyInPandas(fold, schema)


def growing_lines(glyphs: DataFrame, *keys: str) -> DataFrame:
    """Adds line: glyphs (y0, y1) that overlap a line's extent, which grows with each, share it.

    A group is one expression.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in glyphs.schema) + ", line int"

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: list[list[float]] = []
        got = {}
        for i, r in pdf.sort_values(["y0", "y1"], kind="stable").iterrows():
            for n, ext in enumerate(lines):
                if r["y0"] < ext[1] and ext[0] < r["y1"]:
                    ext[:] = [min(ext[0], r["y0"]), max(ext[1], r["y1"])]
                    got[i] = n
                    break
            else:
                got[i] = len(lines)
                lines.append([r["y0"], r["y1"]])
        return pdf.assign(line=pd.Series(got).reindex(pdf.index).astype("int32"))

    return glyphs.groupBy(*keys).applyInPandas(number, schema)


#: A bare bar wider than so many of the widest glyph is an answer blank.
BLANK = 2.5


def decoded_expressions(glyphs: DataFrame, *keys: str) -> DataFrame:
    """(keys.., text): labelled glyphs and bars (kind bar) of one expression as linear text.

    A bar with glyphs above and below is a fraction; one with glyphs only below is an
    overbar, or a radical if a radical glyph touches its left end; a glyph raised by a
    third of the line is an exponent. Bars that touch end to end are one. A bar with nothing
    above or below is a minus, or an answer blank if it is wider than BLANK of the widest
    glyph. A gap between glyphs of more than half a glyph is a blank character.
    """
    schema = ", ".join(f"`{k}` {glyphs.schema[k].dataType.simpleString()}" for k in keys) + ", text string"

    def whole_bars(rows: list[dict]) -> list[dict]:
        bars: list[dict] = []
        for b in sorted((r for r in rows if r["kind"] == "bar"), key=lambda r: (round(r["y0"], 1), r["x0"])):
            a = bars[-1] if bars else None
            if a and abs(a["y0"] - b["y0"]) <= 0.5 and abs(a["y1"] - b["y1"]) <= 0.5 and b["x0"] - a["x1"] <= 0.5:
                a["x1"] = max(a["x1"], b["x1"])
            else:
                bars.append(dict(b))
        return [r for r in rows if r["kind"] != "bar"] + bars

    def decode(rows: list[dict], width: float) -> str:
        bars = sorted((r for r in rows if r["kind"] == "bar"), key=lambda r: r["x0"] - r["x1"])
        if bars:
            b = bars[0]
            rest = [r for r in rows if r is not b]
            inside = [r for r in rest if b["x0"] - 1 <= (r["x0"] + r["x1"]) / 2 <= b["x1"] + 1]
            above = [r for r in inside if r["y1"] <= b["y0"] + 0.5]
            below = [r for r in inside if r["y0"] >= b["y1"] - 0.5]
            root = next((r for r in rest if r.get("label") == "√" and abs(r["x1"] - b["x0"]) <= 2), None)
            taken = {id(r) for r in above + below + ([root] if root else [])}
            if above and below:
                made = f"({decode(above, width)})/({decode(below, width)})"
            elif below:
                made = f"sqrt({decode(below, width)})" if root else f"overbar({decode(below, width)})"
            else:  # a bare bar; what is above it stays
                made = "____" if width and b["x1"] - b["x0"] > BLANK * width else "\u2212"
                taken, above, root = set(), [], None
            token = {"kind": "done", "label": made, "x0": (root or b)["x0"], "x1": b["x1"], "y0": min([r["y0"] for r in above + below] or [b["y0"]]), "y1": max([r["y1"] for r in above + below] or [b["y1"]])}
            return decode([r for r in rest if id(r) not in taken] + [token], width)
        rows = sorted(rows, key=lambda r: r["x0"])
        plain = [r for r in rows if r["kind"] != "done"]
        height = sorted(r["y1"] - r["y0"] for r in plain)[len(plain) // 2] if plain else 0
        bottom = max((r["y1"] for r in plain), default=0)
        out, end = "", None
        for r in rows:
            if end is not None and width and r["x0"] - end > width / 2:
                out += " "
            end = r["x1"] if end is None else max(end, r["x1"])
            raised = r["kind"] != "done" and bottom - r["y1"] > height / 3 and r["y1"] - r["y0"] < height * 1.01
            out += ("^" if raised and not out.endswith("^") and out else "") + r["label"]
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = whole_bars(pdf.to_dict("records"))
        widths = sorted(r["x1"] - r["x0"] for r in rows if r["kind"] != "bar")
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "text": decode(rows, widths[-1] if widths else 0.0)}])

    return glyphs.groupBy(*keys).applyInPandas(run, schema)


def grown_region(region: DataFrame, labels: DataFrame, prose: DataFrame, *keys: str, reach: float) -> DataFrame:
    """The regions' boxes, grown over labels within ``reach`` that share no line with prose."""
    free = labels.join(prose.select(*keys, F.col("y0").alias("_p0"), F.col("y1").alias("_p1")), list(keys), "left")
    on_prose = (F.col("y0") < F.col("_p1")) & (F.col("_p0") < F.col("y1"))
    free = free.groupBy(*keys, "x0", "y0", "x1", "y1").agg(F.max(F.coalesce(on_prose, F.lit(False))).alias("_on")).where("NOT _on").drop("_on")
    near = region.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]).join(free, list(keys), "left")
    close = (F.col("x0") <= F.col("_x1") + reach) & (F.col("x1") >= F.col("_x0") - reach) & (F.col("y0") <= F.col("_y1") + reach) & (F.col("y1") >= F.col("_y0") - reach)
    pick = lambda c: F.when(close, F.col(c))
    g = near.groupBy(*keys, "_x0", "_y0", "_x1", "_y1").agg(F.min(pick("x0")).alias("x0"), F.min(pick("y0")).alias("y0"), F.max(pick("x1")).alias("x1"), F.max(pick("y1")).alias("y1"))
    return g.select(*keys, F.least("_x0", "x0").alias("x0"), F.least("_y0", "y0").alias("y0"), F.greatest("_x1", "x1").alias("x1"), F.greatest("_y1", "y1").alias("y1"))


def verified_points(stated: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """(key, status): same if the stated points are the drawn ones at scale 1 or 2, else differs.

    stated: key, points; drawn: key, points: arrays of (x, y).
    """
    at = lambda c, k: F.array_sort(F.transform(c, lambda p: F.struct((p["x"] * k).alias("x"), (p["y"] * k).alias("y"))))
    met = stated.select(key, F.col("points").alias("_s")).join(drawn.select(key, F.col("points").alias("_d")), key, "full_outer")
    same = (at(F.col("_s"), 1) == at(F.col("_d"), 1)) | (at(F.col("_s"), 2) == at(F.col("_d"), 1))
    status = F.when(F.col("_d").isNull(), "not drawn").when(F.col("_s").isNull(), "not stated").when(same, "same").otherwise("differs")
    return met.select(key, status.alias("status"))
