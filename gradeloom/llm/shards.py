"""K-d tree sharding by size.

Documents are points in a space of metadata dimensions: language, source, length and
number. A node of the tree is split along its widest dimension at a weighted median, so
that the bytes on both sides are in proportion to the shards on both sides, until a node
holds one target's bytes; leaves are the shards.

The tree is a table: each level is a few grouped sums over the rows and joins with the
nodes still to be split, whose number never reaches the driver or an expression. Medians
are found from histograms: the keys of a dimension are read as radix digits, and each
pass narrows every node's cut to one digit more, until the bytes that the cut leaves in
doubt are negligible. Ties within a dimension are ordered by a hash of the row, so copies
and constant columns can be divided too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import forget, saved, table, text_or_empty, unsigned_crc32

DIMENSIONS = ("lang", "source", "n_chars", "doc_id")
#: A dimension has DIM_BITS bits; TIE_BITS bits of hashes follow, the last ROW_BITS of the row itself.
DIM_BITS, TIE_BITS, ROW_BITS, DIGIT_BITS = 24, 36, 8, 12
#: Bytes that a cut may leave in doubt, as a share of its node's.
TOLERANCE = 1e-4
BLOCK_ROWS = 50_000
TOP = (1 << DIM_BITS) - 1


def _text_place(name: str, low: str | None, high: str | None) -> Column:
    """An order-preserving number of a text column: the DIM_BITS bits behind what all of its
    values, which lie between low and high, start with. Null is 0."""
    a, b = (low or "").encode(), (high or "").encode()
    shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    some = F.rpad(F.substring(F.col(name).cast("binary"), shared + 1, DIM_BITS // 8), DIM_BITS // 8, F.lit(b"\0"))
    return F.coalesce(F.conv(F.hex(some), 16, 10).cast("long"), F.lit(0))


def _place(v: Column, low: float | None, high: float | None) -> Column:
    """A number's place between the least and the greatest one; null is 0."""
    low, high = low or 0, high or 0
    return F.coalesce(F.floor((v - F.lit(low)) * (TOP / max(high - low, 1e-9))).cast("long"), F.lit(0))


def points(docs: DataFrame) -> DataFrame:
    """row (unique), doc_id, size, text_crc32, tie and a DIM_BITS-bit coordinate d0.. per dimension."""
    t = text_or_empty()
    length = F.log2(1.0 + F.coalesce(F.greatest(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))
    number = F.col("doc_id").cast("long")
    ends = docs.agg(*[f(c) for c in (F.col("lang"), F.col("source"), length, number) for f in (F.min, F.max)]).head()  # one row
    row = F.monotonically_increasing_id()
    tie = F.pmod(F.xxhash64("doc_id", t), F.lit(1 << (TIE_BITS - ROW_BITS))) * (1 << ROW_BITS) + F.pmod(F.xxhash64(row), F.lit(1 << ROW_BITS))
    return docs.select(
        row.alias("row"),
        "doc_id",
        (F.octet_length(t) + 1).cast("long").alias("size"),
        unsigned_crc32(t).alias("text_crc32"),
        tie.alias("tie"),
        _text_place("lang", *ends[0:2]).alias("d0"),
        _text_place("source", *ends[2:4]).alias("d1"),
        _place(length, *ends[4:6]).alias("d2"),
        _place(number, *ends[6:8]).alias("d3"),
    )


def _key(dimension: Column) -> Column:
    """A row's place along a dimension, ties in the order of the hash."""
    picked = reduce(lambda rest, i: F.when(dimension == i, F.col(f"d{i}")).otherwise(rest), range(1, len(DIMENSIONS)), F.col("d0"))
    return picked * (1 << TIE_BITS) + F.col("tie")


def _to_split(rows: DataFrame, nodes: DataFrame, whole: list[int]) -> DataFrame:
    """(shard, shards, dim, bytes, goal): the nodes of two shards or more that have two keys or
    more, with their widest dimension and the bytes that should lie left of the cut."""
    dims = range(len(DIMENSIONS))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in (*[f"d{i}" for i in dims], "tie") for f in (F.min, F.max)]
    spans = rows.join(nodes.select("shard"), "shard", "left_semi").groupBy("shard").agg(F.sum("size").alias("bytes"), *ends).join(nodes, "shard")
    share = [(F.col(f"max_d{i}") - F.col(f"min_d{i}")) / F.lit(float(max(whole[i], 1))) for i in dims]
    widest = F.greatest(*share)
    dim = reduce(lambda rest, i: F.when(share[i] == widest, i).otherwise(rest), reversed(dims), F.lit(0))
    several = (widest > 0) | (F.col("max_tie") > F.col("min_tie"))
    left = F.floor(F.col("shards") / 2)
    return spans.where((F.col("shards") > 1) & several).select("shard", "shards", dim.alias("dim"), "bytes", (F.col("bytes") * (left / F.col("shards"))).alias("goal"))


def _cuts(rows: DataFrame, nodes: DataFrame, tolerance: float) -> DataFrame:
    """nodes plus cut, the key below which a node's rows go left, and left, their bytes."""
    found = nodes.select("*", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("left"), F.lit(False).alias("done"))
    keyed = rows.join(nodes.select("shard", "dim"), "shard").select("shard", "size", _key(F.col("dim")).alias("key"))
    right = lambda c, n: F.call_function("shiftright", c, F.lit(n))
    for bits in range(DIM_BITS + TIE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        rest = found.where(~F.col("done"))
        inside = keyed.join(rest.select("shard", "low"), "shard").where(right(F.col("key"), bits + DIGIT_BITS) == right(F.col("low"), bits + DIGIT_BITS))
        hist = inside.groupBy("shard", right(F.col("key"), bits).alias("digit")).agg(F.sum("size").alias("in"))
        upto = F.sum("in").over(Window.partitionBy("shard").orderBy("digit"))  # at most 2**DIGIT_BITS rows a node
        met = hist.withColumn("upto", upto).join(rest, "shard").withColumn("before", F.col("left") + F.col("upto") - F.col("in"))
        # the digit that the goal falls into is cut before, behind, or further within
        reaches = F.col("before") + F.col("in") > F.col("goal")
        cell = F.struct("digit", "in", "before")
        pick = met.groupBy("shard").agg(F.coalesce(F.min(F.when(reaches, cell)), F.max(cell)).alias("p")).select("shard", "p.*")
        final = (F.col("in") <= F.lit(tolerance) * F.col("bytes")) if bits else F.lit(True)
        behind = final & (F.abs(F.col("before") + F.col("in") - F.col("goal")) < F.abs(F.col("before") - F.col("goal")))
        low = F.call_function("shiftleft", F.col("digit") + behind.cast("long"), F.lit(bits))
        new = rest.drop("low", "left", "done").join(pick, "shard").withColumns({"low": low, "left": F.col("before") + F.when(behind, F.col("in")).otherwise(0), "done": final})
        step = saved(found.where("done").unionByName(new.select(*found.columns)).repartition(1), "cuts")  # a row a node
        forget(found)
        found = step
        if step.where(~F.col("done")).isEmpty():
            break
    return found.withColumnRenamed("low", "cut").drop("done")


def tree(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Stored points plus shard: the leaf of each row, in 0..shards - 1.

    A node is known by the first of its shards. After a cut, its shards are shared out by
    the bytes really found on either side, one at least to each.
    """
    ends = rows.agg(*[(F.max(f"d{i}") - F.min(f"d{i}")).alias(f"r{i}") for i in range(len(DIMENSIONS))]).head()
    whole = [x or 0 for x in ends]
    rows = rows.withColumn("shard", F.lit(0).cast("long"))
    nodes = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("shards"))
    while True:
        level = saved(_to_split(rows, nodes, whole).repartition(1), "nodes")
        if level.isEmpty():
            return rows
        cuts = _cuts(rows, level, tolerance)
        own = F.floor(F.col("left") / F.col("bytes") * F.col("shards") + 0.5)
        halves = cuts.select("shard", "shards", "dim", "cut", F.least(F.greatest(own, F.lit(1)), F.col("shards") - 1).cast("long").alias("half"))
        joined = rows.join(halves.drop("shards"), "shard", "left")
        goes = F.when(_key(F.col("dim")) >= F.col("cut"), F.col("half")).otherwise(F.lit(0))
        before, rows = rows, saved(joined.withColumn("shard", F.col("shard") + goes).select(*rows.columns), "reached")
        forget(before)
        nodes = saved(
            halves.select("shard", F.col("half").alias("shards")).unionByName(halves.select((F.col("shard") + F.col("half")).alias("shard"), (F.col("shards") - F.col("half")).alias("shards"))).where("shards > 1").repartition(1), "nodes"
        )


def slotted(rows: DataFrame) -> DataFrame:
    """Adds slot: gapless from 0 within each shard, in the order of row, which is unique.

    A shard is dealt by hash into blocks of about a task's share of the rows, BLOCK_ROWS at
    most; a block is numbered in one task and starts where the blocks before it end.
    """
    n, most = rows.groupBy("shard").count().agg(F.sum("count"), F.max("count")).head()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-(most or 0) // min(BLOCK_ROWS, max(1, (n or 0) // tasks))))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("shard").alias("_s"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_start"))
    ranked = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("shard", "_block").orderBy("row")) - 1)
    joined = ranked.join(starts, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_start") + F.col("_in")).cast("long")).drop("_block", "_s", "_b", "_start", "_in")


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``.

    docs: doc_id, text, lang, source, n_chars. The law is ``bytes``: shards of nearly equal
    size. Without ``shards``, there are as many as keep ``target_bytes``, rounded up. Copies
    of a text are rows of their own: a group larger than a shard can't keep this law whole,
    so groups are divided wherever a cut meets them. Null texts count one byte, other nulls
    as 0 along their dimension. A text larger than a shard's share is alone in a shard, and
    fewer shards have rows. Ties are ordered by a hash, repeated rows by a hash of their
    place. An empty table gives an empty result; other columns are not used, whatever their
    names.
    """
    rows = saved(points(docs.select("doc_id", "text", "lang", "source", "n_chars")), "points")
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        total = rows.agg(F.sum("size")).head()[0] or 0
        shards = max(1, -(-total // target_bytes))
    put = tree(rows, shards, tolerance).select("row", "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"))
    return slotted(put).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=8)
