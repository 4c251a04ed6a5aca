"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Vectors get one entry more, which brings them all to the length of the longest one; among
these, the largest inner product is the least Euclidean distance, so the triangle inequality
holds. A tree over a bounded sample deals the vectors to shards, and every shard gets a
tree of its own when it is searched. A ring of distances around a vantage point is passed
over where the triangle inequality puts it beyond ``factor`` times the distance of the
farthest neighbour found so far: factor one is an exact search, less prunes more.

A query is searched in its home shard first, and then in those that the bound leaves. The
factor is fitted: a bounded sample of queries is searched exactly, and the factor is the
one that would have kept the wanted share of their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table
from gradeloom.llm.vectors import matrix, padded, slices, sound, width

#: Vectors of a shard, and of a leaf of its tree.
SHARD_ROWS, LEAF_ROWS = 4096, 64
#: Levels of the tree that deals vectors to shards; beyond it, a shard's vectors are parted by hash.
LEVELS = 10
#: Vectors of the sample for that tree, and queries to fit the factor on, about.
SAMPLE, FIT_QUERIES = 1 << 15, 256
#: Queries that share one copy of a shard's vectors, and queries searched at once.
DEALT_QUERIES, BATCH_QUERIES = 1 << 16, 2048
#: Share of the true neighbours that the fitted factor keeps of the sample's.
RECALL = 0.97
#: What rounding may add to a distance, as a share of the longest vector's length.
ROUNDING = 1e-7


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the entry that makes each as long as the longest."""
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def distances(product: np.ndarray, squares: np.ndarray | float) -> np.ndarray:
    """Distances of inner products; squares: the summed squared lengths of both vectors."""
    return np.sqrt(np.maximum(squares - 2 * product, 0.0))


def reach(bound: np.ndarray, squares: np.ndarray, longest: float, factor: float) -> np.ndarray:
    """Distances beyond which rings are passed over, for the least inner product of a neighbour."""
    d = factor * distances(np.maximum(bound, -1e300), squares + longest**2) + ROUNDING * longest
    return np.where(np.isneginf(bound), np.inf, d)


def vantage(x: np.ndarray, longest: float, rng: np.random.Generator) -> np.ndarray:
    """Of a few lifted vectors, the one whose distances to some others spread most."""
    if not len(x):
        return np.zeros(x.shape[1])
    tried = x[rng.integers(0, len(x), min(5, len(x)))]
    others = x[rng.integers(0, len(x), min(100, len(x)))]
    spread = distances(tried @ others.T, 2 * longest**2).var(axis=1)
    return tried[int(spread.argmax())]


@dataclass
class Node:
    rows: np.ndarray
    point: np.ndarray | None = None
    #: (least distance, greatest distance, node) of each side
    sides: list[tuple[float, float, Node]] = field(default_factory=list)


class Tree:
    """A vantage-point tree over the distinct vectors of a shard."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], longest: float):
        self.x, self.longest = x, longest
        self.ids = ids
        self.first = np.array([i[0] for i in ids], dtype=np.int64)
        self.high = lifted(x, longest)
        self.rng = np.random.default_rng(len(x))
        self.root = self._node(np.arange(len(x)))

    def _node(self, rows: np.ndarray) -> Node:
        if len(rows) <= LEAF_ROWS:
            return Node(rows)
        point = vantage(self.high[rows], self.longest, self.rng)
        d = distances(self.high[rows] @ point, 2 * self.longest**2)
        order = np.argsort(d, kind="stable")
        halves = np.array_split(order, 2)
        return Node(rows, point, [(float(d[h[0]]), float(d[h[-1]]), self._node(rows[h])) for h in halves])

    def search(self, q: np.ndarray, kth: np.ndarray, need: np.ndarray, k: int, factor: float) -> Found:
        """The first k vectors of each query that reach its kth inner product."""
        found = Found(self, q, kth, need, k, factor)
        found.home(self.root, np.arange(len(q)))
        found.visit(self.root, np.arange(len(q)), need)
        return found


class Found:
    """What a search of a tree has found: by query, vectors by falling inner product, then by number."""

    def __init__(self, tree: Tree, q: np.ndarray, kth: np.ndarray, need: np.ndarray, k: int, factor: float):
        self.tree, self.q, self.k, self.factor = tree, q, k, factor
        self.high = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        self.length2 = (q * q).sum(axis=1)
        self.error = 1e-12 * np.sqrt(self.length2) * tree.longest
        #: inner products computed; by query, the inner product that a neighbour must reach
        self.compared = 0
        self.bound = kth - self.error
        self.score = np.full((len(q), k), -np.inf)
        self.row = np.full((len(q), k), -1, dtype=np.int64)
        self.need = np.zeros((len(q), k))

    def to(self, point: np.ndarray, some: np.ndarray) -> np.ndarray:
        return distances(self.high[some] @ point, self.length2[some] + self.tree.longest**2)

    def farthest(self, some: np.ndarray) -> np.ndarray:
        return reach(self.bound[some], self.length2[some], self.tree.longest, self.factor)

    def home(self, node: Node, some: np.ndarray) -> None:
        """Bounds from the leaf that a query itself would be in."""
        while some.size and node.point is not None:
            d = self.to(node.point, some)
            inner = d <= (node.sides[0][1] + node.sides[1][0]) / 2
            self.home(node.sides[0][2], some[inner])
            node, some = node.sides[1][2], some[~inner]
        if some.size and len(node.rows) >= self.k:
            s = self.q[some] @ self.tree.x[node.rows].T
            at = len(node.rows) - self.k
            self.bound[some] = np.maximum(self.bound[some], np.partition(s, at, axis=1)[:, at] - self.error[some])

    def visit(self, node: Node, some: np.ndarray, need: np.ndarray) -> None:
        """need: of each of these queries, the greatest gap to a ring on the way."""
        if node.point is None:
            self.leaf(node.rows, some, need)
            return
        d = self.to(node.point, some)
        for least, greatest, below in node.sides:
            gap = np.maximum(np.maximum(least - d, d - greatest), need)
            near = gap <= self.farthest(some)
            if near.any():
                self.visit(below, some[near], gap[near])

    def leaf(self, rows: np.ndarray, some: np.ndarray, need: np.ndarray) -> None:
        s = self.q[some] @ self.tree.x[rows].T
        self.compared += s.size
        at, col = np.nonzero(s >= self.bound[some][:, None])
        if not len(at):
            return
        hit, back = np.unique(at, return_inverse=True)
        query = some[hit]
        exact = (self.q[some[at]] * self.tree.x[rows[col]]).sum(axis=1)  # the same for equal vectors, in any batch
        held = self.row[query] >= 0
        owner = np.concatenate([np.nonzero(held)[0], back])
        score = np.concatenate([self.score[query][held], exact])
        row = np.concatenate([self.row[query][held], rows[col]])
        gap = np.concatenate([self.need[query][held], need[at]])
        order = np.lexsort((self.tree.first[row], -score, owner))
        owner, score, row, gap = owner[order], score[order], row[order], gap[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < self.k
        owner, place = owner[kept], place[kept]
        self.score[query[owner], place] = score[kept]
        self.row[query[owner], place] = row[kept]
        self.need[query[owner], place] = gap[kept]
        self.bound[query] = np.maximum(self.bound[query], self.score[query, self.k - 1] - self.error[query])


@dataclass(frozen=True)
class Top:
    """The tree that deals vectors to shards: its inner nodes as a heap, and the rings of the shards.

    near and far: (shards x levels) least and greatest distances of a shard's vectors to the
    vantage points above it.
    """

    points: np.ndarray
    cuts: np.ndarray
    levels: int
    longest: float
    near: np.ndarray
    far: np.ndarray

    @property
    def above(self) -> np.ndarray:
        """The heap's nodes (shards x levels) above each shard."""
        shard = np.arange(1 << self.levels)
        return np.stack([(1 << level) - 1 + (shard >> (self.levels - level)) for level in range(self.levels)], axis=1) if self.levels else np.zeros((1, 0), dtype=np.int64)

    def down(self, d: np.ndarray) -> np.ndarray:
        """The shards of rows of distances to the inner nodes."""
        shard = np.zeros(len(d), dtype=np.int64)
        for level in range(self.levels):
            node = (1 << level) - 1 + shard
            shard = 2 * shard + (d[np.arange(len(d)), node] > self.cuts[node])
        return shard

    def gaps(self, d: np.ndarray) -> np.ndarray:
        """(rows x shards) what the triangle inequality puts at least between a query and a shard."""
        if not self.levels:
            return np.zeros((len(d), 1))
        out = np.zeros((len(d), 1 << self.levels))
        above = self.above
        for level in range(self.levels):
            to = d[:, above[:, level]]
            np.maximum(out, np.maximum(self.near[:, level] - to, to - self.far[:, level]), out=out)
        return out


def planted(sample: np.ndarray, levels: int, longest: float) -> Top:
    """A dealing tree of so many levels over a sample; its rings aren't known yet."""
    high = lifted(sample, longest)
    rng = np.random.default_rng(len(sample))
    points, cuts = np.zeros(((1 << levels) - 1, high.shape[1])), np.zeros((1 << levels) - 1)
    inside = [np.arange(len(high))]
    for level in range(levels):
        below = []
        for i, rows in enumerate(inside):
            node = (1 << level) - 1 + i
            points[node] = vantage(high[rows], longest, rng)
            d = distances(high[rows] @ points[node], 2 * longest**2)
            cuts[node] = np.median(d) if len(d) else 0.0
            below += [rows[d <= cuts[node]], rows[d > cuts[node]]]
        inside = below
    none = np.zeros((1 << levels, levels))
    return Top(points, cuts, levels, longest, none, none)


@dataclass(frozen=True)
class Index:
    """rows: (shard, part, v, ids), stored; the distinct vectors with their first numbers."""

    rows: DataFrame
    top: Top
    dim: int
    parts: int
    each: int


def squared(v: str) -> Column:
    """The squared length of a vector."""
    return F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))


def distinct_vectors(embeddings: DataFrame, column: str, number: str, each: int) -> DataFrame:
    """(v, ids): each distinct vector with its ``each`` least numbers, stored.

    More numbers of one vector can't be among the first ``each`` of any query, so a vector
    that very many rows have is a single one.
    """
    vector = embeddings.schema[column].dataType.simpleString()
    entry = "float" if vector == "array<float>" else "double"
    rows = embeddings.select(F.transform(column, lambda c: c.cast(entry) + F.lit(0).cast(entry)).alias("v"), F.col(number).cast("long").alias("id"))
    one = rows.where(sound("v") & F.exists("v", lambda c: c != 0) & F.col("id").isNotNull())
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = one.distinct().withColumn("place", place).where(F.col("place") <= each)
    found = saved(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    low, high = width(found, "v")
    if low < high:
        zero = F.lit(0).cast(entry)
        flat = found.select(padded("v", high, zero).alias("v"), F.explode("ids").alias("id")).distinct()
        found = saved(flat.withColumn("place", place).where(F.col("place") <= each).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    return found


def _table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def build(embeddings: DataFrame, column: str = "embedding", number: str = "vec_id", each: int = 21) -> Index:
    """An index over every vector that takes part (see op13). Fitted on about SAMPLE vectors at most."""
    found = distinct_vectors(embeddings, column, number, each)
    n, dim = found.count(), width(found, "v")[1]
    longest = float(found.agg(F.max(F.sqrt(squared("v")))).head()[0] or 0.0)
    levels = min(max(int(np.ceil(np.log2(max(n, 1) / SHARD_ROWS))), 0), LEVELS)
    parts = max(-(-n // (SHARD_ROWS << levels)), 1)
    spark = embeddings.sparkSession
    entry = found.schema["v"].dataType.simpleString()
    picked = found.where(F.pmod(F.xxhash64("v"), F.lit(max(n, 1))) < SAMPLE).select("v") if levels else found.select("v").limit(0)
    sample = [r["v"] for r in picked.collect()]
    top = planted(np.array(sample, dtype=np.float64).reshape(len(sample), dim), levels, longest)
    shared = spark.sparkContext.broadcast(top)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for piece in slices(batches, dim):
            d = distances(lifted(matrix(piece.column(0), dim), top.longest) @ top.points.T, 2 * top.longest**2)
            shard = top.down(d)
            way = d[np.arange(len(d))[:, None], top.above[shard]].reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * top.levels, pa.int32()), pa.array(way))
            yield _table({"shard": pa.array(shard, pa.int32()), "way": lists, "v": piece.column(0), "ids": piece.column(1)})

    dealt = saved(found.mapInArrow(deal, f"shard int, way array<double>, v {entry}, ids array<long>"), "dealt")
    rows = dealt.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int")).select("shard", "part", "v", "ids")
    if levels:
        ends = [f(F.element_at("way", i + 1)) for f in (F.min, F.max) for i in range(levels)]
        near, far = np.full((1 << levels, levels), np.inf), np.full((1 << levels, levels), -np.inf)
        for r in dealt.groupBy("shard").agg(*ends).collect():  # a row a shard
            near[r[0]], far[r[0]] = r[1 : levels + 1], r[levels + 1 :]
        top = Top(top.points, top.cuts, levels, longest, near, far)
    return Index(rows, top, dim, parts, each)


DEALT = "shard int, key long, v {}, kth double, need double"
#: same: whether the hit's vector is the query's.
HITS = "key long, id long, score double, need double, same boolean"


def _shards(index: Index, queries: DataFrame, factor: float, home: bool) -> DataFrame:
    """(key, v, kth) dealt to their home shards, or to all others that the bound leaves."""
    spark = queries.sparkSession
    entry = queries.schema["v"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(index.top)
    dim = index.dim

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        wide = max(dim, 1 << top.levels)
        for piece in slices(batches, wide):
            q = matrix(piece.column(1), dim)
            kth = piece.column(2).to_numpy(zero_copy_only=False)
            squares = (q * q).sum(axis=1)
            d = distances(q @ top.points[:, :-1].T, squares[:, None] + top.longest**2)
            own = top.down(d)
            if home:
                row, shard = np.arange(len(q)), own
                need = np.zeros(len(q))
            else:
                gaps = top.gaps(d)
                near = gaps <= reach(kth, squares, top.longest, factor)[:, None]
                near[np.arange(len(q)), own] = False
                row, shard = np.nonzero(near)
                need = gaps[row, shard]
            for at in range(0, len(row), len(q)):
                r = slice(at, at + len(q))
                taken = pa.array(row[r])
                yield _table({"shard": pa.array(shard[r], pa.int32()), "key": piece.column(0).take(taken), "v": piece.column(1).take(taken), "kth": pa.array(kth[row[r]]), "need": pa.array(need[r])})

    return queries.select("key", "v", "kth").mapInArrow(deal, DEALT.format(entry))


def _searched(index: Index, dealt: DataFrame, blocks: int, factor: float) -> DataFrame:
    """HITS of dealt queries: the first vectors of each in each shard it was dealt to."""
    dim, each, longest = index.dim, index.each, index.top.longest
    none = F.lit(None)
    asked = dealt.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1))).alias("part"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "key", "v", none.cast("array<long>").alias("ids"), "kth", "need"
    )
    there = index.rows.select("shard", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), none.cast("long").alias("key"), "v", "ids", none.cast("double").alias("kth"), none.cast("double").alias("need"))

    def answers(tree: Tree, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, piece.num_rows, BATCH_QUERIES):
            some = piece.slice(at, BATCH_QUERIES)
            keys, kth, need = (some.column(c).to_numpy(zero_copy_only=False) for c in ("key", "kth", "need"))
            asked = matrix(some.column("v"), dim)
            found = tree.search(asked, kth.astype(float), need.astype(float), each, factor)
            q, place = np.nonzero(found.row >= 0)
            ids = [tree.ids[r] for r in found.row[q, place]]
            again = np.repeat(np.arange(len(q)), [len(i) for i in ids])
            flat = np.concatenate([np.asarray(i, dtype=np.int64) for i in ids]) if ids else np.zeros(0, dtype=np.int64)
            q, place = q[again], place[again]
            score, gap = found.score[q, place], found.need[q, place]
            same = (asked[q] == tree.x[found.row[q, place]]).all(axis=1)
            order = np.lexsort((flat, -score, q))
            q, flat, score, gap, same = q[order], flat[order], score[order], gap[order], same[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < each
            yield _table({"key": pa.array(keys[q[first]].astype(np.int64)), "id": pa.array(flat[first]), "score": pa.array(score[first]), "need": pa.array(gap[first]), "same": pa.array(same[first])})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[pa.RecordBatch] = []
        tree: Tree | None = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "part", "block", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                here, kind, piece = tuple(keys[lo][:3].tolist()), int(keys[lo][3]), batch.slice(lo, hi - lo)
                if here != at:
                    at, held, tree = here, [], None
                if kind == 0:
                    held.append(piece)
                elif held:
                    if tree is None:
                        x = np.concatenate([matrix(p.column("v"), dim) for p in held])
                        tree = Tree(x, [i for p in held for i in p.column("ids").to_pylist()], longest)
                    yield from answers(tree, piece)

    groups = (1 << index.top.levels) * index.parts * blocks
    key = ["shard", "part", "block"]
    return there.unionByName(asked).repartition(groups, *key).sortWithinPartitions(*key, "kind").mapInArrow(search, HITS)


def _best(hits: DataFrame, each: int) -> DataFrame:
    """The first ``each`` hits of every key, with their place."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return hits.withColumn("place", place).where(F.col("place") <= each)


def nearest(index: Index, queries: DataFrame, factor: float, blocks: int = 1) -> DataFrame:
    """(key, id, score, need, same, place): the ``index.each`` nearest rows found of each query (key, v)."""
    open_ = queries.select("key", "v", F.lit(float("-inf")).alias("kth"))
    home = saved(_searched(index, _shards(index, open_, factor, True), blocks, factor), "home")
    known = queries.join(_kth(home, index.each), "key", "left").select("key", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    rest = _searched(index, _shards(index, known, factor, False), blocks, factor)
    return saved(_best(home.unionByName(rest), index.each), "nearest")


def _kth(hits: DataFrame, each: int) -> DataFrame:
    return _best(hits, each).where(F.col("place") == each).select("key", F.col("score").alias("kth"))


def fitted_factor(index: Index, queries: DataFrame, recall: float = RECALL, sample: int = FIT_QUERIES) -> float:
    """The factor that keeps ``recall`` of the true neighbours of about ``sample`` queries, which are searched exactly.

    A neighbour is kept if no ring on its way is farther than factor times the distance of the
    last neighbour; the search itself prunes by a larger distance while it runs.
    """
    n = queries.count()
    some = queries.where(F.pmod(F.xxhash64("v"), F.lit(max(n, 1))) < sample)
    rows = nearest(index, some, 1.0).join(some.select("key", squared("v").alias("length2")), "key").select("key", "score", "need", "length2").collect()  # `sample` times `each`
    if not rows:
        return 1.0
    found = pd.DataFrame([tuple(r) for r in rows], columns=["key", "score", "need", "length2"])
    last = found.groupby("key")["score"].transform("min")
    far = distances(last.to_numpy(), found["length2"].to_numpy() + index.top.longest**2)
    wanted = np.sort(np.where(far > 0, found["need"] / np.where(far > 0, far, 1.0), 0.0))
    return float(min(wanted[min(int(np.ceil(recall * len(wanted))), len(wanted)) - 1], 1.0))


def neighbours(embeddings: DataFrame, asked: Column, k: int = 20, factor: float | None = None, column: str = "embedding", number: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row for which ``asked`` holds.

    factor: 1.0 searches exactly, None fits it (see ``fitted_factor``). Nulls, ties and odd
    vectors as in ``op13_nearest_neighbours``.
    """
    index = build(embeddings, column, number, k + 1)
    entry = index.rows.schema["v"].dataType.elementType.simpleString()
    zero = F.lit(0).cast(entry)
    own = embeddings.where(asked).select(F.col(number).cast("long").alias("query_id"), F.transform(column, lambda c: c.cast(entry) + zero).alias("v"))
    own = own.where(F.col("query_id").isNotNull() & sound("v") & F.exists("v", lambda c: c != 0))
    own = own.select("query_id", padded("v", index.dim, zero).alias("v")).distinct()
    queries = saved(own.select("v").distinct().withColumn("key", F.monotonically_increasing_id()), "queries")
    blocks = max(-(-queries.count() // DEALT_QUERIES), 1)
    if factor is None:
        factor = fitted_factor(index, queries)
    cell = F.struct("place", F.col("id").alias("vec_id"), "score", "same")
    found = nearest(index, queries, factor, blocks).groupBy("key").agg(F.sort_array(F.collect_list(cell)).alias("found"))  # k + 1 each
    answered = own.join(queries.join(found, "key").select("v", "found"), "v")
    others = F.slice(F.filter("found", lambda c: (c["vec_id"] != F.col("query_id")) | ~c["same"]), 1, k)
    out = answered.select("query_id", F.posexplode(others).alias("at", "c"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "c.vec_id", "c.score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row of ``embeddings`` whose vec_id is divisible by 20.

    Vectors that are null, zero, empty or hold null or non-finite entries take no part, nor do
    rows without vec_id. Shorter vectors have zeros behind them. Ties go to the smaller vec_id.
    Rows that repeat number and vector count once; rows of one number with different vectors
    are candidates each, also for each other, and queries each. Fewer candidates than 20 are
    all returned; an empty table gives an empty result. Other columns aren't used, whatever
    their names.
    """
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
