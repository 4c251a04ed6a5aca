"""Secret scanning behind a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams. The
index holds postings (trigram, text key) for the trigrams that some rule asks for;
intersecting them gives each rule's candidate texts, and only those are verified
with the expression. A rule without mandatory trigrams scans every text.

Only DataFrame functions are used on the executors; queries are derived on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table, text_or_empty
from gradeloom.llm.trigrams import query


@dataclass(frozen=True)
class Rule:
    """pattern: in the common subset of Java's and Python's syntax; a match counts if
    ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base kinds, then further formats. A run of a character class that
#: must have k characters is written {k,}: maximal runs are matched either way.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: Bits of one mask column.
WORD_BITS = 60


def text_key(text: str = "text") -> Column:
    return F.xxhash64(text_or_empty(text))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries mention, sorted."""
    return sorted({t for r in rules for clause in query(r.pattern) for alt in clause for t in alt})


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, key): the distinct texts, by hash, that hold each trigram in lower case.

    Copies share a posting; two texts with one hash only add a candidate.
    """
    low = docs.select(text_key().alias("key"), F.lower(text_or_empty()).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary(rules))]))
    return low.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): a bit for every rule whose query the postings of a text satisfy."""
    words = vocabulary(rules)
    number = {t: i for i, t in enumerate(words)}
    groups = range(0, max(len(words), 1), WORD_BITS)
    bits = [
        F.bit_or(F.when(F.col("trigram").between(g, g + WORD_BITS - 1), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") - g)).otherwise(F.lit(0).cast("long"))).alias(f"w{g}")
        for g in groups
    ]
    met = postings.groupBy("key").agg(*bits)

    def has(alt: frozenset[str]) -> Column:
        tests = []
        for g in groups:
            if need := sum(1 << (number[t] - g) for t in alt if g <= number[t] < g + WORD_BITS):
                tests.append(F.col(f"w{g}").bitwiseAND(F.lit(need).cast("long")) == F.lit(need).cast("long"))
        return reduce(lambda a, b: a & b, tests)

    mask = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        if clauses := query(r.pattern):
            true = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [has(alt) for alt in c]) for c in clauses])
            mask = mask + F.when(true, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return met.select("key", mask.alias("rules")).where(F.col("rules") != 0)


def matches(rule: Rule, order: int, text: str = "_t") -> Column:
    """array<struct<start,kind_no,end,kind>> of a rule's leftmost, non-overlapping matches.

    The text between the matches and the matches themselves add up to their places, in
    code points.
    """
    gaps = F.transform(F.split(F.col(text), rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else found
    each = F.arrays_zip(gaps.alias("gap"), found.alias("len"), tested.alias("tested"))
    kind = "array<struct<start:int,no:int,end:int,kind:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        span = F.struct(start.alias("start"), F.lit(order).alias("no"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(x["tested"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).cast(kind).alias("out"),
        )

    return F.aggregate(each, zero, step, lambda acc: acc["out"])


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (any columns, with text) plus _spans, sorted by start, then rule order."""
    found = saved(candidates(saved(index(docs, rules), "postings"), rules), "candidates").withColumnRenamed("key", "_key").withColumnRenamed("rules", "_rules")
    joined = docs.withColumn("_key", text_key()).join(found, "_key", "left").withColumn("_t", text_or_empty())
    none = F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")
    parts = []
    for i, r in enumerate(rules):
        hit = F.col("_rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0 if query(r.pattern) else F.lit(True)
        parts.append(F.when(hit & F.col("_t").rlike(r.pattern), matches(r, i)).otherwise(none))
    return joined.withColumn("_spans", F.array_sort(F.concat(*parts))).drop("_key", "_rules", "_t")


def _of(spans: str, no: int) -> Column:
    return F.filter(spans, lambda s: s["no"] == no)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<base kind>.., base_sha256, spans: one row per row of ``docs``.

    Null texts count as empty: no spans, the digest of the empty string. Every copy of
    a text gets its own row; other columns are not used, whatever their names.
    """
    got = with_spans(docs.select("doc_id", "text"), rules).drop("text")
    base = [i for i, r in enumerate(rules) if r.base]
    mine = F.filter("_spans", lambda s: s["no"].isin(base))
    counts = [F.size(_of("_spans", i)).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    return got.select("doc_id", *counts, F.sha2(joined_spans(mine), 256).alias("base_sha256"), joined_spans(F.col("_spans")).alias("spans"))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with each span's characters replaced by its kind in brackets.

    Where spans overlap, the characters are replaced once, under the first one's kind.
    n_chars, if there, follows the text; a null text stays null.
    """
    names = docs.columns
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    got = with_spans(packed, rules)
    t = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        start = F.greatest(s["start"], acc["at"])
        cut = F.when(ahead, F.concat(F.substring(t, acc["at"] + 1, start - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], cut).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    clean = got.withColumn("_clean", F.when(F.size("_spans") > 0, rest).otherwise(t))
    out = []
    for c in names:
        if c == "text":
            out.append(F.col("_clean").alias("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            out.append(F.when(F.size("_spans") > 0, F.length("_clean").cast(kind)).otherwise(F.col("_row.n_chars")).alias("n_chars"))
        else:
            out.append(F.col(f"_row.`{c}`").alias(c))
    return clean.select(*out)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The query in DuckDB's SQL: a plain scan with every rule."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT rid, {i} AS no, '{r.kind}' AS kind, unnest(string_split_regex(t, '{p}')) AS gap,
         unnest(list_append(regexp_extract_all(t, '{p}'), NULL)) AS hit,
         unnest(list_append(regexp_extract_all(t, '{p}', {r.group}), NULL)) AS tested,
         {r.least} AS least, unnest(range(len(string_split_regex(t, '{p}')))) AS k FROM d""")
    base = ", ".join(str(i) for i, r in enumerate(rules) if r.base)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)
    aggs = ", ".join(f"count(*) FILTER (WHERE no = {i}) AS n_{r.kind}" for i, r in enumerate(rules) if r.base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY rid, no ORDER BY k) AS stop FROM raw),
span AS (
  SELECT rid, no, CAST(stop - length(hit) AS BIGINT) AS start, kind || ':' || CAST(stop - length(hit) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s
  FROM placed WHERE hit IS NOT NULL AND length(tested) >= least),
per AS (
  SELECT rid, {aggs}, string_agg(s, ',' ORDER BY start, no) AS spans, string_agg(s, ',' ORDER BY start, no) FILTER (WHERE no IN ({base})) AS base
  FROM span GROUP BY rid)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)"""


ORACLE = oracle()
