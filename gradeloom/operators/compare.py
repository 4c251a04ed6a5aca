"""Structural comparison of two builds of a table with nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from gradeloom.operators.stored import checkpointed


def _plain(c: Column, kind: DataType) -> Column:
    """A value that can be compared and hashed: maps become lists of entries, by key."""
    if isinstance(kind, StructType):
        if not kind.fields:
            return c
        return F.when(c.isNotNull(), F.struct(*[_plain(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.sort_array(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), _plain(e["value"], kind.valueType).alias("v"))))
    return c


def _text(c: Column, kind: DataType) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"}) if isinstance(kind, (StructType, ArrayType, MapType)) else c.cast("string")


def _opened(pairs: DataFrame, kind: DataType, keys: list[str]) -> list[DataFrame]:
    """(keys.., path, kind, old, new) of pairs (keys.., path, old, new, in_old, in_new) that differ: one
    table for each place of the schema, however many elements there are."""
    pairs = pairs.where(~(F.col("in_old") & F.col("in_new") & _plain(F.col("old"), kind).eqNullSafe(_plain(F.col("new"), kind))))
    both = F.col("in_old") & F.col("in_new") & F.col("old").isNotNull() & F.col("new").isNotNull()
    what = F.when(~F.col("in_old"), "added").when(~F.col("in_new"), "lost").otherwise("changed")
    leaf = lambda df: df.select(*keys, "path", what.alias("kind"), _text(F.col("old"), kind).alias("old"), _text(F.col("new"), kind).alias("new"))
    old, new, yes = F.col("old"), F.col("new"), F.lit(True)
    if isinstance(kind, StructType):
        out = [leaf(pairs.where(~both))]
        for f in kind.fields:
            path = F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), F.lit(f.name))
            out += _opened(pairs.where(both).select(*keys, path.alias("path"), old.getField(f.name).alias("old"), new.getField(f.name).alias("new"), yes.alias("in_old"), yes.alias("in_new")), f.dataType, keys)
        return out
    if isinstance(kind, ArrayType):
        most = F.greatest(F.size("old"), F.size("new"))
        each = pairs.where(both & (most > 0)).select(*keys, "path", "old", "new", F.explode(F.sequence(F.lit(0), most - 1)).alias("_i"))
        path = F.concat(F.col("path"), F.lit("["), F.col("_i").cast("string"), F.lit("]"))
        items = each.select(*keys, path.alias("path"), F.get("old", F.col("_i")).alias("old"), F.get("new", F.col("_i")).alias("new"), (F.col("_i") < F.size("old")).alias("in_old"), (F.col("_i") < F.size("new")).alias("in_new"))
        return [leaf(pairs.where(~both)), *_opened(items, kind.elementType, keys)]
    if isinstance(kind, MapType):
        each = pairs.where(both).select(*keys, "path", "old", "new", F.explode(F.array_union(F.map_keys("old"), F.map_keys("new"))).alias("_k"))
        path = F.concat(F.col("path"), F.lit("["), F.col("_k").cast("string"), F.lit("]"))
        has = lambda c: F.array_contains(F.map_keys(c), F.col("_k"))
        items = each.select(*keys, path.alias("path"), F.try_element_at("old", F.col("_k")).alias("old"), F.try_element_at("new", F.col("_k")).alias("new"), has("old").alias("in_old"), has("new").alias("in_new"))
        return [leaf(pairs.where(~both)), *_opened(items, kind.valueType, keys)]
    return [leaf(pairs)]


def differences(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """(keys.., path, kind, old, new): where two builds differ, leaf by leaf; kind: added, lost or changed.

    Paths are as ``meta.n``, ``rows[3].key``, ``marks[x]``; a row, element or entry that only one
    build has is one difference with its whole text, and so is a null against something. Rows
    are first compared by digests, so only those that differ are sent and opened; within a row
    only subtrees that differ are.

    Both have the same columns in any order. Of rows of one key the copies are paired in the
    order of their digests; null keys are equal. A list's elements are compared by position.
    """
    k = list(keys)
    rest = [c for c in old.columns if c not in keys]
    row = StructType([old.schema[c] for c in rest])

    def digested(df: DataFrame) -> DataFrame:
        whole = F.struct(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in rest])
        d = df.select(*k, whole.alias("_row")).withColumn("_digest", F.sha2(F.to_json(F.struct(_plain(F.col("_row"), row).alias("r")), {"ignoreNullFields": "false"}), 256))
        return d.withColumn("_copy", F.row_number().over(Window.partitionBy(*k, "_digest").orderBy("_digest")))

    a, b = digested(old), digested(new)
    on = [*k, "_digest", "_copy"]

    def only(df: DataFrame, other: DataFrame) -> DataFrame:
        o = other.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(on)])
        same = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(on)]
        left = df.join(o, _all(same), "left_anti")
        return left.withColumn("_n", F.row_number().over(Window.partitionBy(*k).orderBy("_digest", "_copy")))

    x, y = only(a, b), only(b, a)
    y = y.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*k, "_n"])], F.col("_row").alias("_new"))
    same = _all([F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*k, "_n"])])
    met = x.join(y, same, "full")
    in_old, in_new = F.col("_n").isNotNull(), F.col(f"_k{len(k)}").isNotNull()
    pairs = met.select(*[F.when(in_old, F.col(c)).otherwise(F.col(f"_k{i}")).alias(c) for i, c in enumerate(k)], F.lit("").alias("path"), F.col("_row").alias("old"), F.col("_new").alias("new"), in_old.alias("in_old"), in_new.alias("in_new"))
    parts = _opened(checkpointed(pairs), row, k)  # rows that differ, read for each place of the schema
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
