"""N-gram Jaccard self-join by chosen paths.

Texts are sets of five-word shingles; minwise hashing maps a set to TOKENS tokens such
that two sets share a token with the probability of their similarity. A node of the
path tree holds texts; it is split on a few sampled tokens, and texts that share one go
on together. Small buckets are compared by brute force over the tokens. A pair at the
threshold survives a run with a known probability, so RUNS runs reach the target
recall; a bucket that doesn't fall apart is compared in blocks, never cut.

The candidate pairs only serve to find components: what a task finds leaves it as stars
of the components within the task, not as pairs. All pairs within a component are then verified on the whole shingle sets, in
blocks, and every text gets its exact number of links. Copies are counted, never
expanded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table
from gradeloom.llm.components import components
from gradeloom.llm.worker import Memory, task

WORDS = 5
TOKENS = 64
#: A bucket of at most LEAF texts is compared; of at most LOCAL, split further within one task.
LEAF, LOCAL = 128, 4096
#: Levels that are split over the cluster, and within a task; deeper buckets are compared in blocks.
LEVELS, DEPTH = 6, 10
#: Levels that the first runs reckon with; texts on deeper paths get further runs.
SHALLOW = 3
#: Texts and shingles in a block of pairwise verification.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1_000_000
#: Bytes of words and their hashes that a task remembers.
MEMORY = 48 << 20
#: Bits of the filter that spares rows without a partner the shuffle: 64 bits a row, it is the
#: bound of what is broadcast. With more members than bits it lets more texts pass, never fewer.
FILTER_BITS = 1 << 25


@dataclass(frozen=True)
class Join:
    """threshold: least similarity of a link; slack: how far below it the share of equal
    tokens may fall for a candidate (four standard deviations of TOKENS tokens)."""

    threshold: float = 0.8
    recall: float = 0.999
    slack: float = 0.2

    @property
    def least(self) -> int:
        return int(np.ceil((self.threshold - self.slack) * TOKENS))

    @property
    def runs(self) -> int:
        """Runs such that a pair at the threshold is in a common leaf of one of them with
        the target recall, were it to pass SHALLOW levels of splits in each."""
        return int(np.ceil(np.log(1 - self.recall) / np.log(self._missed(SHALLOW))))

    def _missed(self, levels: int) -> float:
        """Probability that a pair at the threshold has no common leaf in a run of so many levels."""
        once = 1.0
        for _ in range(levels):
            once = 1 - (1 - self.threshold * once) * (1 - 0.25 * self.threshold * once)
        return 1 - once

    def runs_at(self, levels: int) -> int:
        """Runs that texts need whose paths go through so many levels of splits.

        A pair is missed if it is parted within SHALLOW levels in all first runs, so that its
        texts may not get further ones, or if it is parted in all runs of all levels.
        """
        if levels <= SHALLOW:
            return self.runs
        left = (1 - self.recall) - self._missed(SHALLOW) ** self.runs
        left = left if left > 0 else (1 - self.recall) / 2
        return max(self.runs, int(np.ceil(np.log(left) / np.log(self._missed(levels)))))


class Hasher:
    """64-bit shingle hashes of texts, as sorted arrays without repeats."""

    def __init__(self) -> None:
        self.memory = Memory(MEMORY)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split()  # blanks and \t \n \v \f \r
        memory = self.memory
        memory.add({w: hashlib.blake2b(w, digest_size=8).digest() for w in memory.missing(words)})
        h = np.frombuffer(b"".join(map(memory.new.__getitem__, words)), dtype="<u8")
        memory.turn()
        if not len(h):
            return h
        n = max(len(h) - WORDS + 1, 1)
        mix = np.full(n, np.uint64(min(len(h), WORDS)))
        for i in range(min(WORDS, len(h))):
            mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        return np.unique(_mixed(mix))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The TOKENS minwise tokens (32 bits each) of a set."""
    out = np.full(TOKENS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for p in range(0, len(shingles), 2048):
        x = shingles[p : p + 2048, None] * FACTORS + OFFSETS
        out = np.minimum(out, (x.min(axis=0) >> np.uint64(32)).astype(np.uint32))
    return out


def chosen(path: int) -> list[int]:
    """The token positions on which a node is split: one, and in one of four cases another."""
    seed = int(_mixed(np.array([path], dtype=np.uint64))[0])
    first = seed % TOKENS
    if (seed >> 32) % 4:
        return [first]
    return [first, (first + 1 + (seed >> 16) % (TOKENS - 1)) % TOKENS]


def child(path: int, position: int, values: np.ndarray) -> np.ndarray:
    """The path keys below a node for the values of one position."""
    mixed = ((path ^ (position + 1)) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    return _mixed(values.astype(np.uint64) + np.uint64(mixed))


# --- buckets -----------------------------------------------------------------------


def forest(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows that share ``least`` tokens or more."""
    n = len(sig)
    label = np.arange(n)
    edges = []
    for i in range(n - 1):
        alike = np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= least) + i + 1
        for root in np.unique(label[alike]):
            if root != label[i]:
                edges.append((i, int(alike[np.argmax(label[alike] == root)])))
                label[label == root] = label[i]
    return edges


def split(path: int, sig: np.ndarray, least: int, depth: int, reached: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Candidate edges below a node that fits into one task.

    reached gets the depth of the deepest leaf of each of ``rows``.
    """
    if len(sig) <= LEAF or depth >= DEPTH:
        reached[rows] = np.maximum(reached[rows], depth)
        yield from forest(sig, least)
        return
    for position in chosen(path):
        keys = child(path, position, sig[:, position])
        order = np.argsort(keys, kind="stable")
        bounds = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, bounds):
            if len(part) > 1:
                for a, b in split(int(keys[part[0]]), sig[part], least, depth + 1, reached, rows[part]):
                    yield int(part[a]), int(part[b])


def _runs(parts: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by ``by``, across the batches."""
    held: list[pd.DataFrame] = []
    for df in parts:
        if not len(df):
            continue
        keys = df[by].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(df)]
        if held and (held[-1][by].iloc[-1].to_numpy() != keys[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if held and lo > 0:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(df.iloc[lo:hi])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _sigs(column: pd.Series, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, TOKENS)


def halved(sig: str) -> F.Column:
    """The lower 16 bits of every token, as bytes: what is compared within a bucket. Equal tokens
    stay equal, so no pair is lost; different ones become equal once in 65,536 times."""
    return F.unhex(F.regexp_replace(F.hex(sig), "(.{4}).{4}", "$1"))


def _mapped(rows: DataFrame, f: Callable, schema: str) -> DataFrame:
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with task():
            yield from f(parts)

    return rows.mapInPandas(work, schema)


def _grouped(rows: DataFrame, by: list[str], f: Callable, schema: str) -> DataFrame:
    """f over the groups of ``by``, many small ones in a task."""
    return _mapped(rows.repartition(*by).sortWithinPartitions(*by), f, schema)


#: An edge, or with b null the levels of splits that a text went through, if more than SHALLOW.
EDGES = "a binary, b binary, levels int"


def _edges(a: list, b: list, levels: list | None = None) -> pd.DataFrame:
    return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object), "levels": pd.Series(levels or [0] * len(a), dtype="int32")})


def _star_edges(found: list[tuple]) -> pd.DataFrame:
    edges = stars(found)
    return _edges([a for a, _ in edges], [b for _, b in edges])


def stars(edges: list[tuple]) -> list[tuple]:
    """Edges of the same components, each from the least member to another one."""
    up: dict = {}

    def root(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for x, y in edges:
        x, y = sorted((root(x), root(y)))
        up[y] = x
    return [(r, x) for x in up if (r := root(x)) != x]


def bucket_edges(buckets: DataFrame, least: int, levels: int) -> DataFrame:
    """Candidate edges of buckets (path, text_id, halved sig) of at most LOCAL texts, after ``levels`` splits, as stars."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for group in _runs(parts, ["path"]):
            sig = _sigs(group["sig"], np.uint16)
            ids = group["text_id"].tolist()
            reached = np.zeros(len(ids), dtype=np.int32)
            for i, j in split(int(group["path"].iloc[0]) & (1 << 64) - 1, sig, least, 0, reached, np.arange(len(ids))):
                found.append((ids[i], ids[j]))
            deep = np.flatnonzero(reached + levels > SHALLOW) if len(ids) > 1 else []
            if len(deep):
                yield _edges([ids[i] for i in deep], [None] * len(deep), (reached[deep] + levels).tolist())
            if len(found) > 50_000:
                yield _star_edges(found)
                found = []
        yield _star_edges(found)

    return _grouped(buckets, ["path"], work, EDGES)


def block_edges(buckets: DataFrame, least: int) -> DataFrame:
    """The same for buckets that didn't fall apart: every two blocks of a bucket meet once."""
    sized = buckets.join(buckets.groupBy(F.col("path").alias("_p")).agg(F.count("*").alias("_n")), F.col("path") == F.col("_p"))
    dealt = sized.withColumn("blocks", F.ceil(F.col("_n") * 2 / LOCAL).cast("int")).withColumn("block", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = met.select("path", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "text_id", "sig")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(parts, ["path", "x", "y"]):
            ids = group["text_id"].tolist()
            yield _star_edges([(ids[i], ids[j]) for i, j in forest(_sigs(group["sig"], np.uint16), least)])

    return _grouped(pairs, ["path", "x", "y"], work, EDGES)


def candidate_edges(sigs: DataFrame, join: Join) -> DataFrame:
    """(a, b): edges that connect every text to those it may be linked with.

    sigs: (text_id, sig), stored and distinct. Texts that went through more than SHALLOW levels
    of splits get further runs among themselves, until the runs suffice for the levels reached.
    """
    found, done, runs, levels, texts = [], 0, join.runs, SHALLOW, sigs
    while runs > done:
        new = run_edges(texts, join, done, runs)
        found += new
        deep = new[0]
        for x in new[1:]:
            deep = deep.unionByName(x)
        deep = deep.where(F.col("b").isNull())
        most = deep.agg(F.max("levels")).head()[0]
        if most is None and done == 0:
            break
        levels = max(levels, most or 0)
        if done == 0:
            ids = saved(deep.select(F.col("a").alias("text_id")).distinct(), "deep")
            texts = saved(ids.join(sieved(sigs, ids), "text_id"), "deep")
        done, runs = runs, join.runs_at(levels)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.where(F.col("b").isNotNull()).select("a", "b")


def run_edges(sigs: DataFrame, join: Join, done: int, runs: int) -> list[DataFrame]:
    """Stored rows of EDGES of the runs after the first ``done``."""
    least = join.least
    roots = [int(x) for x in _mixed(np.arange(done + 1, runs + 1, dtype=np.uint64))]

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            sig = _sigs(df["sig"])
            for root in roots:
                for position in chosen(root):
                    yield pd.DataFrame({"path": child(root, position, sig[:, position]).view(np.int64), "text_id": df["text_id"]})

    def deeper(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            sig = _sigs(df["sig"])
            out_path, out_row = [], []
            paths = df["path"].to_numpy().view(np.uint64)
            for path in np.unique(paths):
                rows = np.flatnonzero(paths == path)
                for position in chosen(int(path)):
                    out_path.append(child(int(path), position, sig[rows, position]).view(np.int64))
                    out_row.append(rows)
            if out_path:
                yield pd.DataFrame({"path": np.concatenate(out_path), "text_id": df["text_id"].to_numpy()[np.concatenate(out_row)]})

    def with_sig(rows: DataFrame, sigs: DataFrame) -> DataFrame:
        return rows.join(sieved(sigs, rows), "text_id").select("path", "text_id", "sig")

    found = []
    halves = sigs.select("text_id", halved("sig").alias("sig"))
    paths = saved(_mapped(sigs, first, "path long, text_id binary"), "paths")
    for level in range(LEVELS):
        sizes = saved(paths.groupBy(F.col("path").alias("_p")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1), "buckets")
        shared = sieved(paths, sizes.select(F.col("_p").alias("path")), "path")
        alive = saved(shared.join(sizes, F.col("path") == F.col("_p")).select("path", "text_id", "_n"), "alive")
        found.append(saved(bucket_edges(with_sig(alive.where(F.col("_n") <= LOCAL), halves), least, level + 1), "candidates"))
        large = alive.where(F.col("_n") > LOCAL)
        if sizes.where(F.col("_n") > LOCAL).isEmpty():
            break
        if level == LEVELS - 1:
            found.append(saved(block_edges(with_sig(large, halves), least), "candidates"))
            if LEVELS > SHALLOW:
                found.append(saved(large.select(F.col("text_id").alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(LEVELS).alias("levels")).distinct(), "candidates"))
        else:
            paths = saved(_mapped(with_sig(large, sigs), deeper, "path long, text_id binary"), "paths")
    return found


# --- verification ------------------------------------------------------------------


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of the pairs of sets whose similarity is the threshold or more (none with itself)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n <= 6:
        both = np.zeros((n, n), dtype=np.int64)
        for i in range(n):
            for j in range(i):
                if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]) - 1e-9:
                    both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        owner = np.repeat(np.arange(n), sizes)
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], column[shared]
        number = np.cumsum(times > 1) - 1
        column = number[column]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((n, n), dtype=np.float32)
        width = max(1, min(8192, 8_000_000 // n))
        for lo in range(0, int((times > 1).sum()), width):
            i, j = np.searchsorted(column, (lo, lo + width))
            x = np.zeros((n, width), dtype=np.float32)
            x[owner[i:j], column[i:j] - lo] = 1
            both += x @ x.T  # counts below 2**24 are exact
        both = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    # both / union >= threshold in whole numbers
    top = round(threshold * 1000)
    out = both * 1000 >= top * union
    np.fill_diagonal(out, False)
    return out


def _spanning(match: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links, by breadth-first search."""
    n = len(match)
    seen = np.zeros(n, dtype=bool)
    edges = []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        queue = [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(match[i] & ~seen)
            seen[new] = True
            edges += [(i, int(j)) for j in new]
            queue += new.tolist()
    return edges


def dealt(members: DataFrame) -> DataFrame:
    """``members`` (comp, n, and the text's id ``_id``) with the number of blocks of their component and their own."""
    sizes = members.groupBy(F.col("comp").alias("_c")).agg(F.count("*").alias("_t"), F.sum("n").alias("_s"))
    blocks = F.greatest(F.ceil(F.col("_t") / BLOCK_TEXTS), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("int")
    sized = members.join(sizes, F.col("comp") == F.col("_c")).withColumn("_blocks", blocks)
    return sized.withColumn("block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")).drop("_c", "_t", "_s")


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links, texts) from rows (comp, _blocks, block, text_id, copies, text).

    A row with b null counts linked documents (links, by their copies) and texts of a; the
    counts of a text's rows add up. The rows with b are stars of the components that the links of
    a task form. Texts are compared whole; a similarity that ties with the threshold is a link; a text that comes
    twice counts once; no members give no rows.
    """
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pairs = met.select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "text_id", "copies", "text")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        out: list[tuple] = []
        edges: list[tuple] = []

        def taken() -> pd.DataFrame:
            rows = out + [(a, b, 0, 0) for a, b in stars(edges)]
            out.clear()
            edges.clear()
            return pd.DataFrame(rows, columns=["a", "b", "links", "texts"])

        for group in _runs(parts, ["comp", "x", "y"]):
            group = group.drop_duplicates("text_id")
            sets = [hasher(t) for t in group["text"]]
            match = linked(sets, threshold)
            x, y = group["x"].iloc[0], group["y"].iloc[0]
            block = group["block"].to_numpy()
            if x != y:  # within a block, pairs are counted where the block meets itself
                match &= block[:, None] != block[None, :]
            ids = group["text_id"].tolist()
            links = match @ group["copies"].to_numpy().astype(np.int64)
            out += [(i, None, int(n), int(t)) for i, n, t in zip(ids, links, match.sum(axis=1), strict=True) if t]
            edges += [(ids[i], ids[j]) for i, j in _spanning(match)]
            if len(out) + len(edges) > 50_000:
                yield taken()
        yield taken()

    return _grouped(pairs, ["comp", "x", "y"], work, "a binary, b binary, links long, texts long")


# --- the join ----------------------------------------------------------------------


def _text_id() -> F.Column:
    """16 bytes of a digest of a text with a word; null for others."""
    return F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def signatures(docs: DataFrame) -> DataFrame:
    """(text_id, sig, n): tokens and number of shingles of every distinct text with a word."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for df in parts:
            sig, n = [], []
            for t in df["text"]:
                s = hasher(t)
                n.append(len(s))
                sig.append(tokens(s).tobytes())
            yield pd.DataFrame({"text_id": df["text_id"], "sig": sig, "n": n})

    rows = docs.select(_text_id().alias("text_id"), "text").where(F.col("text_id").isNotNull())
    each = _mapped(rows, work, "text_id binary, sig binary, n long")
    return each.groupBy("text_id").agg(F.first("sig").alias("sig"), F.first("n").alias("n"))


def sifted(rows: DataFrame, ids: DataFrame, *key: str) -> DataFrame:
    """``rows`` with ``_maybe``: true where ``ids`` has the same ``key``, and for few others."""
    bit = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    place = bit.bitwiseAND(F.lit(63)).cast("int")
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    slot = F.call_function("shiftright", bit, F.lit(6))
    table = saved(ids.groupBy(slot.alias("_slot")).agg(F.bit_or(ones).alias("_bits")), "sieve")
    met = rows.withColumn("_slot", slot).join(F.broadcast(table), "_slot", "left")
    has = F.call_function("shiftright", F.coalesce("_bits", F.lit(0)), place).bitwiseAND(F.lit(1)) == 1
    return met.select(*rows.columns, has.alias("_maybe"))


def sieved(rows: DataFrame, ids: DataFrame, key: str = "text_id") -> DataFrame:
    """``rows`` that may have a ``key`` of ``ids``: all that have one, and few others."""
    return sifted(rows, ids, key).where("_maybe").drop("_maybe")


def text_classes(docs: DataFrame, join: Join) -> DataFrame:
    """(text_id, root, class_id, copies, links, texts): one row per distinct text with a word.

    docs: doc_id and text, of any length; null, empty and blank texts have no row. root is
    null for a text without links. Copies and repeated rows count as copies of one text; of
    ties for class_id, the least doc_id counts. An empty table gives an empty result.
    """
    ids = docs.select("doc_id", _text_id().alias("text_id")).where(F.col("text_id").isNotNull())
    texts = saved(ids.groupBy("text_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "texts")
    sigs = saved(signatures(docs), "signatures")
    comps = components(candidate_edges(sigs, join))
    # the texts of the components' members, each from the row with its least doc_id; the
    # members grow with the corpus, so they are never broadcast
    wanted = comps.select(F.col("id").alias("text_id"), F.col("root").alias("comp")).join(texts, "text_id").join(sigs.select("text_id", "n"), "text_id")
    wanted = saved(wanted.select(F.col("text_id").alias("_id"), "comp", "first", "copies", "n"), "wanted")
    # blocks are dealt before the texts come, so that these are shuffled only by id and by block
    wanted = saved(dealt(wanted), "wanted")
    whole = sieved(docs.select("doc_id", "text", _text_id().alias("text_id")), wanted.select(F.col("_id").alias("text_id")))
    members = whole.join(wanted.hint("merge"), (F.col("text_id") == F.col("_id")) & F.col("doc_id").eqNullSafe(F.col("first")))
    # repeated rows (equal id and text) would bring a text twice
    members = members.select("comp", "_blocks", "block", "text_id", "copies", "text")
    checked = saved(verified(members, join.threshold), "verified")
    counts = checked.where(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    groups = saved(components(checked.where(F.col("b").isNotNull()).select("a", "b")), "groups")
    joined = texts.join(groups.select(F.col("id").alias("text_id"), "root"), "text_id", "left")
    joined = joined.join(counts.withColumnRenamed("a", "text_id"), "text_id", "left")
    least = joined.where(F.col("root").isNotNull()).groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("_least"))
    labelled = joined.join(least, F.col("root") == F.col("_root"), "left")
    return labelled.select(
        "text_id",
        "root",
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("_least")).alias("class_id"),
        "copies",
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("texts", F.lit(0)).alias("texts"),
    )


def jaccard_join(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links: one row per row of ``docs``.

    Documents are linked if their shingle sets' similarity is the threshold or more;
    classes are the connected components, named by their least doc_id. n_links counts
    linked documents, copies included; n_text_links counts different texts. A text of
    fewer than five words is one shingle. Null and blank texts have no shingle: a class
    of their own and no links. Repeated rows are copies. An empty table gives an empty
    result; other columns are not used.
    """
    own = docs.select("doc_id", "text")
    classes = saved(text_classes(own, join), "classes")
    ids = own.select("doc_id", _text_id().alias("_id"))
    out = ids.join(classes, F.col("_id") == F.col("text_id"), "left")
    return out.select(
        "doc_id",
        F.when(F.col("_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("texts"), F.lit(0)).cast("long").alias("n_text_links"),
    )


def one_per_class(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of ``docs`` that stay: of each class, a row with the least doc_id.

    Rows without a word all stay. Null doc_ids stay only where a class has no other.
    """
    names = docs.columns
    classes = saved(text_classes(docs.select("doc_id", "text"), join).select("text_id", F.coalesce("root", "text_id").alias("_class"), "class_id"), "classes")
    ids = docs.select("doc_id", _text_id().alias("_id"))
    rows = ids.join(classes, F.col("_id") == F.col("text_id")).select("_id", "doc_id", "_class", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("_first"))
    rows = saved(rows.groupBy("_id", "doc_id", "_class", "_first").agg(F.count("*").alias("_k")), "rows")
    # a class whose least doc_id comes on several rows keeps one of them
    several = rows.where("_first").groupBy(F.col("_class").alias("_several")).agg(F.sum("_k").alias("_k")).where("_k > 1").select("_several")
    once = rows.where("_first").join(several, F.col("_class") == F.col("_several")).select("_id", "doc_id", "_several")
    judged = saved(rows.where("NOT _first").select("_id", "doc_id", F.lit(None).cast("binary").alias("_several")).unionByName(once), "judged")
    # texts are shuffled only for rows that may have a verdict; the others stay as they are
    packed = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), _text_id().alias("_id"))
    asked = sifted(packed, judged, "_id", "doc_id")
    verdicts = judged.select(F.col("_id").alias("_of"), F.col("doc_id").alias("_doc"), "_several")
    marked = asked.where("_maybe").join(verdicts, (F.col("_id") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    stays = asked.where("NOT _maybe").select("_row").unionByName(marked.where("_of IS NULL").select("_row"))
    if judged.where("_several IS NOT NULL").isEmpty():
        return stays.select("_row.*")
    first = marked.where("_several IS NOT NULL").dropDuplicates(["_several"])
    return stays.unionByName(first.select("_row")).select("_row.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
