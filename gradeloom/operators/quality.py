"""Data-quality rules and privacy guards as tables of findings.

A rule is a named column that is true where a row breaks it. Outcomes are ok, fail, warn
or skip; a skipped check never counts as passed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column
    level: str = "fail"
    applies: Column | None = None


def violations(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(key, rule, level): a row for every rule that a row breaks, in one pass."""
    found = [
        F.when(F.coalesce(r.broken, F.lit(False)) & (F.lit(True) if r.applies is None else F.coalesce(r.applies, F.lit(False))), F.struct(F.lit(r.name).alias("rule"), F.lit(r.level).alias("level")))
        for r in rules
    ]
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("_v")).select(key, "_v.*")


def outcomes(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, checked, broken, status): skip where a rule applies to no row."""
    aggs = []
    for i, r in enumerate(rules):
        on = F.lit(True) if r.applies is None else F.coalesce(r.applies, F.lit(False))
        aggs += [F.count_if(on).alias(f"c{i}"), F.count_if(on & F.coalesce(r.broken, F.lit(False))).alias(f"b{i}")]
    one = df.agg(*aggs)
    pairs = ", ".join(f"'{r.name}', '{r.level}', c{i}, b{i}" for i, r in enumerate(rules))
    long = one.select(F.expr(f"stack({len(rules)}, {pairs}) as (rule, level, checked, broken)"))
    status = F.when(F.col("checked") == 0, "skip").when(F.col("broken") == 0, "ok").otherwise(F.col("level"))
    return long.select("rule", "checked", "broken", status.alias("status"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """(keys.., n): keys that occur more than once; nulls aside."""
    present = df.where(F.col(keys[-1]).isNotNull())
    return present.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def contradictory(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): keys printed with more than one value."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def lopsided(df: DataFrame, value: str, *keys: str, share: float = 0.6) -> DataFrame:
    """(keys.., value, n, total): a value that takes more than ``share`` of its group."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", value)).alias(value), F.max("n").alias("n"), F.sum("n").alias("total"))
    return top.where(F.col("n") > F.col("total") * share)


def reconciled(counts: DataFrame, expected: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, field, got, expected): where counts differ; missing counts are 0."""
    e = expected.select(key, *[F.col(f).alias(f"e_{f}") for f in fields])
    met = counts.join(e, key, "full_outer")
    pairs = ", ".join(f"'{f}', coalesce(cast({f} as bigint), 0L), coalesce(cast(e_{f} as bigint), 0L)" for f in fields)
    return met.select(key, F.expr(f"stack({len(fields)}, {pairs}) as (field, got, expected)")).where("got <> expected")


def unresolved(refs: DataFrame, known: DataFrame, ref: str, key: str) -> DataFrame:
    """References without a target, with how often each occurs."""
    return refs.where(F.col(ref).isNotNull()).join(known.select(F.col(key).alias(ref)).distinct(), ref, "left_anti").groupBy(ref).agg(F.count("*").alias("n"))


# --- privacy -----------------------------------------------------------------------

#: Fields that no published table and no report may have, at any depth.
BANNED_PAYLOAD = ("pctCorrect", "distractors", "zeroCredit", "results", "perStudent", "uid", "studentName", "osis", "roster")
BANNED_REPORT = ("pl", "plByStudent", "rawByStudent", "perStudent", "students_", "roster", "osis", "studentName")
#: Further fields of persons.
PERSONAL = ("student", "first_name", "last_name", "birth_date", "dob", "email", "phone", "address")
BANNED = (*BANNED_PAYLOAD, *BANNED_REPORT, *PERSONAL)
#: Fields with published prose, whose words may look like names.
PROSE = ("stemPlain", "topWrongText", "choiceList", "label", "lessonTitle", "unitTitle", "sourceUrl", "domainLabel")
#: Fields that may hold long texts, what the others may hold, and the parts of a payload that are written by hand.
LONG_TEXTS = (
    "clusterText", "notes", "domainLabel", "subscore", "basis", "postTestNote", "note", "stem", "stemPlain", "stemHtml", "stemAfter", "prose", "text", "alt",
    "longDescription", "answer", "check", "creditLine", "source", "itemText",
)
LONGEST_TEXT = 300
UNCAPPED = ("meta", "blueprint", "curriculum.meta")
#: Words end at all but ASCII letters, digits and underscores, whatever a JVM's ``\b`` is: an accented letter hides nothing.
IDENTIFIER = r"(?<![0-9A-Za-z_])\d{9}(?![0-9A-Za-z_])"
SURNAME_FORENAME = r"(?<![0-9A-Za-z_])[A-Z]{2,}, ?[A-Z]{2,}(?![0-9A-Za-z_])"
#: Codes of sections are no longer than this.
LONGEST_SECTION = 8


def _plain(name: str) -> str:
    """A field's name in one spelling: ``raw_by_student`` is ``rawByStudent``; a last underscore stays."""
    return re.sub(r"_(?=.)", "", name).lower()


def _leaf(path: str) -> str:
    """The spelling of a path's last field."""
    return _plain(re.sub(r"(\[\]|\{key\}|\{\})+$", "", path).split(".")[-1])


def fields(kind: T.DataType, path: str = "") -> list[tuple[str, T.DataType]]:
    """(path, type) of every field, nested ones below their parent."""
    out = []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            here = f"{path}.{f.name}" if path else f.name
            out.append((here, f.dataType))
            out += fields(f.dataType, here)
    elif isinstance(kind, T.ArrayType):
        out += fields(kind.elementType, f"{path}[]")
    elif isinstance(kind, T.MapType):
        out += fields(kind.valueType, f"{path}{{}}")
    return out


def banned_fields(df: DataFrame, banned: tuple[str, ...] = BANNED) -> list[str]:
    """Paths of the schema whose last part is banned."""
    names = {_plain(b) for b in banned}
    return [p for p, _ in fields(df.schema) if _leaf(p) in names]


def string_leaves(kind: T.StructType, exempt: tuple[str, ...] = ()) -> list[tuple[str, Callable]]:
    """(path, f) of every string of a schema, however deep; f(test) is whether one passes the test.

    A field that is exempt, by its name or its whole path, is passed over with all below it.
    """
    spared = {_plain(e) for e in exempt}

    def walk(t: T.DataType, path: str, reach: Callable) -> list[tuple[str, Callable]]:
        if isinstance(t, T.StringType):
            return [(path, reach)]
        if isinstance(t, T.ArrayType):
            return walk(t.elementType, f"{path}[]", lambda f: reach(lambda v: F.coalesce(F.exists(v, f), F.lit(False))))
        if isinstance(t, T.MapType):
            inside = lambda part: lambda f: reach(lambda v: F.coalesce(F.exists(part(v), f), F.lit(False)))
            return walk(t.keyType, f"{path}{{key}}", inside(F.map_keys)) + walk(t.valueType, f"{path}{{}}", inside(F.map_values))
        if isinstance(t, T.StructType):
            out = []
            for x in t.fields:
                here = f"{path}.{x.name}" if path else x.name
                if _plain(x.name) in spared or _plain(here) in spared:
                    continue
                at = (lambda n: lambda f: reach(lambda v: f(v[n])))(x.name) if path else (lambda n: lambda f: f(F.col(f"`{n}`")))(x.name)
                out += walk(x.dataType, here, at)
            return out
        return []

    return walk(kind, "", lambda f: f)


def identity_findings(df: DataFrame, exempt: tuple[str, ...] = (), cap: int | None = None, uncapped: tuple[str, ...] = ()) -> DataFrame:
    """(column, kind, n): rows with identifiers, names, over-long section codes, banned keys of
    maps and, with ``cap``, over-long texts, by the path of the string, however deep it is.

    ``uncapped`` are the fields, or paths, that may hold long texts.
    """
    free = {p for p, _ in string_leaves(df.schema)} - {p for p, _ in string_leaves(df.schema, uncapped)}
    tests = []
    for path, reach in string_leaves(df.schema, exempt):
        kinds = [("identifier", lambda c: c.rlike(IDENTIFIER)), ("surname-forename", lambda c: c.rlike(SURNAME_FORENAME))]
        if path.endswith("{key}"):
            names = [_plain(b) for b in BANNED]
            kinds.append(("banned-key", lambda c: F.lower(F.regexp_replace(c, "_(?=.)", "")).isin(names)))
        if _leaf(path) in ("section", "sections"):
            kinds.append(("section-code", lambda c: F.length(c) > LONGEST_SECTION))
        if cap is not None and path not in free:
            kinds.append(("too-long", lambda c: F.length(c) > cap))
        tests += [(path, k, reach((lambda g: lambda v: F.coalesce(g(v), F.lit(False)))(f))) for k, f in kinds]
    if not tests:
        return df.sparkSession.createDataFrame([], "column string, kind string, n bigint")
    one = df.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(f"n{i}") for i, (_, _, t) in enumerate(tests)])
    pairs = ", ".join(f"'{c}', '{k}', n{i}" for i, (c, k, _) in enumerate(tests))
    return one.select(F.expr(f"stack({len(tests)}, {pairs}) as (column, kind, n)")).where("n > 0")


def assert_private(df: DataFrame, exempt: tuple[str, ...] = (), banned: tuple[str, ...] = BANNED, label: str = "table", cap: int | None = None) -> DataFrame:
    """``df``; ValueError if its schema or its texts could identify somebody.

    Fields of published prose (PROSE) are not searched for names.
    """
    if bad := banned_fields(df, banned):
        raise ValueError(f"{label}: banned fields: {', '.join(bad)}")
    if hits := identity_findings(df, (*PROSE, *exempt), cap, (*LONG_TEXTS, *UNCAPPED)).collect():  # one row per path and kind
        raise ValueError(f"{label}: possible identities in " + ", ".join(f"{h['column']} ({h['kind']})" for h in hits))
    return df
