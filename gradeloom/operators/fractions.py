"""Fractions that are typeset as three runs of small type: a rule, what stands above it and below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.drawings import area, meeting
from gradeloom.operators.stored import checkpointed, forget

#: Sizes of body type; of small type and of rules, as shares of the body's usual size.
BODY_LEAST, BODY_MOST, SMALL, RULE_LEAST, RULE_MOST = 10.0, 12.5, 0.55, 0.75, 0.98
#: How far beside and above or below its rule a piece may stand; what counts as above.
BESIDE, REACH, LEVEL = 1.0, 14.0, 0.5
RULE = r"^_+$"


def _clean(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def taken_pieces(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys.., rule, id, above): the pieces that each rule takes, of pairs (keys.., rule, id, above).

    Rules come in order; each takes all pieces that none before it took, if some are above and some
    below. In rounds: a rule decides when no undecided one before it wants a piece of its own, so
    rules that share nothing decide at once; there are as many rounds as rules that wait for each other.
    """
    left = checkpointed(pairs.select(*keys, "rule", "id", "above").distinct())
    out = left.limit(0)
    while not left.isEmpty():
        first = left.groupBy(*keys, "id").agg(F.min("rule").alias("_first"))
        each = left.join(first, [*keys, "id"]).groupBy(*keys, "rule").agg(F.bool_and(F.col("rule") == F.col("_first")).alias("_due"), (F.bool_or("above") & F.bool_or(~F.col("above"))).alias("_whole"))
        due = checkpointed(each.where("_due").select(*keys, "rule", "_whole"))
        took = checkpointed(left.join(due.where("_whole").select(*keys, "rule"), [*keys, "rule"]))
        out = out.unionByName(took)
        rest = checkpointed(left.join(due.select(*keys, "rule"), [*keys, "rule"], "left_anti").join(took.select(*keys, "id"), [*keys, "id"], "left_anti"))
        forget(left)
        left = rest
    return out


def folded_fractions(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys.., id, x, x1, y, size, text): the body spans, with a span ``above/below`` for each fraction, which
    has its rule's id and stands where the rule does; other small type is left out.

    spans: keys.., id (their order), x, x1, y, size, text. The body's size is the most frequent one, to a
    tenth; of equally frequent ones the least. Keys without body type have no spans. Rules with
    one side only (blanks, underlines) make no fraction; a piece belongs to the first rule that wants it.
    """
    one = checkpointed(spans.select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in ("x", "x1", "y", "size")], "text"))
    body = one.where(F.col("size").between(BODY_LEAST, BODY_MOST))
    sizes = body.groupBy(*keys, F.round("size", 1).alias("_dom")).agg(F.count("*").alias("_n"))
    usual = sizes.groupBy(*keys).agg(F.max_by("_dom", F.struct(F.col("_n"), -F.col("_dom"))).alias("_dom"))
    small = one.join(usual, list(keys)).where((F.col("size") >= SMALL * F.col("_dom")) & (F.col("size") < BODY_LEAST)).withColumn("_rule", F.trim("text").rlike(RULE))
    small = checkpointed(small)
    x, x1, y = F.col("x"), F.col("x1"), F.col("y")
    rules = small.where(F.col("_rule") & F.col("size").between(RULE_LEAST * F.col("_dom"), RULE_MOST * F.col("_dom")))
    a = rules.select(*keys, F.col("id").alias("rule"), y.alias("_y"), area(x - BESIDE, y - REACH, x1 + BESIDE, y + REACH).alias("area"))
    b = small.where("NOT _rule").select(*keys, "id", area(x, y, x1, y).alias("area2"))
    pairs = meeting(a, b, *keys).select(*keys, "rule", "id", (F.col("area2.y0") <= F.col("_y") + LEVEL).alias("above"))
    took = taken_pieces(pairs, *keys).join(small.select(*keys, "id", "x", "text"), [*keys, "id"])
    side = lambda up: _clean(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("above") == up, F.struct("x", "id", "text")))), lambda p: p["text"]), ""))
    texts = took.groupBy(*keys, F.col("rule").alias("id")).agg(F.concat(side(True), F.lit("/"), side(False)).alias("_t"))
    made = rules.drop("text").join(texts, [*keys, "id"]).select(*keys, "id", "x", "x1", (F.col("y") + 1.5).alias("y"), F.col("_dom").alias("size"), F.col("_t").alias("text"))
    return body.select(*keys, "id", "x", "x1", "y", "size", "text").unionByName(made)
