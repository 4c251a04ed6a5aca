"""Audit of how sources of a language differ in their terms.

Every partition counts terms in radix tries of bytes, one a language, whose leaves hold the
documents and a counter a source. The tries' leaves leave a task in byte order; they are
dealt by prefix range, where runs of equal leaves merge, so a range's trie is never held
whole. The merged leaves, in UTF-8 order, are walked in chunks: each adds to the
divergence of pairs of sources and offers its own top terms.

All arithmetic is over whole numbers.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table

#: Documents of a language in which a term must be found.
DOCUMENTS = 10
SCALE = 1_000_000_000
TOP = 10
#: Leaves that a task's tries hold before they move on, and bytes of texts that are counted at once.
LEAVES, BYTES = 200_000, 8 << 20
#: Terms of a chunk and sources of a block, which are compared in one task.
CHUNK, BLOCK = 4096, 256

#: A-Z become a-z, what else is no letter of ASCII becomes a blank; bytes from 128 on stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Leaf:
    """How many documents have a term, and how often each source has it."""

    __slots__ = ("documents", "sources")

    def __init__(self) -> None:
        self.documents = 0
        self.sources: dict[str, int] = {}

    def merge(self, other: Leaf) -> None:
        self.documents += other.documents
        for source, n in other.sources.items():
            self.sources[source] = self.sources.get(source, 0) + n


class Trie:
    """A radix trie of bytes: an edge has a label of one byte or more, a node may have a leaf."""

    __slots__ = ("leaves", "root")

    def __init__(self) -> None:
        self.root: list = [{}, None]
        #: the leaves by term, for those that are met again
        self.leaves: dict[bytes, Leaf] = {}

    def leaf(self, term: bytes) -> Leaf:
        """The leaf of a term, made where it's new."""
        found = self.leaves.get(term)
        if found is not None:
            return found
        node, rest = self.root, term
        while rest:
            edges = node[0]
            edge = edges.get(rest[0])
            if edge is None:
                node = edges[rest[0]] = (rest, [{}, None])
                node = node[1]
                break
            label, below = edge
            if not rest.startswith(label):
                same, most = 1, min(len(label), len(rest))
                while same < most and label[same] == rest[same]:
                    same += 1
                below = [{label[same]: (label[same:], below)}, None]
                label = label[:same]
                edges[rest[0]] = (label, below)
            node, rest = below, rest[len(label) :]
        node[1] = self.leaves[term] = Leaf()
        return node[1]

    def walk(self) -> Iterator[tuple[bytes, Leaf]]:
        """Terms and leaves in the order of bytes."""
        todo = [(b"", self.root)]
        while todo:
            prefix, node = todo.pop()
            if node[1] is not None:
                yield prefix, node[1]
            edges = node[0]
            for first in sorted(edges, reverse=True) if len(edges) > 1 else edges:
                label, below = edges[first]
                todo.append((prefix + label, below))

    def merge(self, other: Trie) -> None:
        for term, leaf in other.walk():
            self.leaf(term).merge(leaf)


LEAF = "lang string, term string, documents long, sources array<string>, counts array<long>"
KEPT = "lang string, chunk long, term string, total long, sources array<string>, counts array<long>"


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _drained(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
    """The leaves of tries, LEAF rows in the order of bytes."""
    for lang in sorted(tries):
        walk = tries[lang].walk()
        while held := list(islice(walk, CHUNK)):
            sizes = [len(leaf.sources) for _, leaf in held]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(held), pa.string()),
                    pa.array([term for term, _ in held], pa.binary()).cast(pa.string()),
                    pa.array([leaf.documents for _, leaf in held], pa.int64()),
                    _lists(np.array(sizes), pa.array([s for _, leaf in held for s in leaf.sources], pa.string())),
                    _lists(np.array(sizes), pa.array([n for _, leaf in held for n in leaf.sources.values()], pa.int64())),
                ],
                ["lang", "term", "documents", "sources", "counts"],
            )


def _words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word) of every term of some texts, numbered, and the words: runs of ASCII letters, lower-cased, and characters from U+0080 on."""
    _, offsets, data = texts.buffers()
    folded = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(FOLD)), offset=texts.offset)
    split = pc.ascii_split_whitespace(folded)
    text, flat = pc.list_parent_indices(split), split.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    return text.filter(some).to_numpy(), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _add(tries: dict[str, Trie], batch: pa.RecordBatch) -> None:
    """Counts the terms of some documents in the tries of their languages."""
    text, word, words = _words(batch.column("text"))
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    n = max(len(words), 1)
    once = np.sort(text * n + word)
    once = once[np.diff(once, prepend=-1) > 0]  # a document's terms, each once
    found, documents = np.unique(lang.indices.to_numpy().astype(np.int64)[once // n] * n + once % n, return_counts=True)
    spelt = pc.cast(words, pa.binary())
    rank = np.empty(len(words), dtype=np.int64)
    rank[pc.sort_indices(spelt).to_numpy()] = np.arange(len(words))
    spelt = spelt.to_pylist()
    leaves: list[Leaf] = [None] * len(found)  # type: ignore[list-item]
    for k, name in enumerate(langs):
        lo, hi = np.searchsorted(found, (k * n, k * n + n)).tolist()
        if lo == hi:
            continue
        trie = tries.setdefault(name, Trie())
        known, made = trie.leaves.get, trie.leaf
        own = found[lo:hi] - k * n
        order = np.argsort(rank[own])  # neighbours in a trie after each other
        for i, w, number in zip((order + lo).tolist(), own[order].tolist(), documents[lo:hi][order].tolist(), strict=True):
            leaf = leaves[i] = known(spelt[w]) or made(spelt[w])
            leaf.documents += number
    group = lang.indices.to_numpy().astype(np.int64) * len(sources) + source.indices.to_numpy()
    cells, counts = np.unique(group[text] * n + word, return_counts=True)
    group, word = cells // n, cells % n
    at = np.searchsorted(found, group // max(len(sources), 1) * n + word)
    for i, s, count in zip(at.tolist(), (group % max(len(sources), 1)).tolist(), counts.tolist(), strict=True):
        held = leaves[i].sources
        name = sources[s]
        held[name] = held.get(name, 0) + count


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gc.disable()  # a trie has no cycles, and the collector would walk it again and again
    try:
        yield from _counted_batches(batches)
    finally:
        gc.enable()


def _counted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[str, Trie] = {}
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
        lo = 0
        while lo < batch.num_rows:  # about BYTES of texts, one at least
            hi = max(int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BYTES, side="right")), lo + 1)
            _add(tries, batch.slice(lo, hi - lo))
            lo = hi
            if sum(len(t.leaves) for t in tries.values()) >= LEAVES:
                yield from _drained(tries)
                tries = {}
    yield from _drained(tries)


def _merged(least: int):  # noqa: ANN202
    def joined(rows: pa.Table, numbered: Counter) -> Iterator[pa.RecordBatch]:
        """KEPT rows of whole runs of equal leaves."""
        lang, term = rows["lang"].combine_chunks(), rows["term"].combine_chunks()
        starts = _starts(lang, term)
        run = np.repeat(np.arange(len(starts)), np.diff([*starts, len(term)]))
        keep = np.add.reduceat(rows["documents"].to_numpy(), starts) >= least
        wanted = np.flatnonzero(keep[run])
        if not len(wanted):
            return
        some = rows.take(pa.array(wanted))
        sources, counts = some["sources"].combine_chunks(), some["counts"].combine_chunks()
        place = np.cumsum(keep)[run[wanted]] - 1  # of a row's run among those kept
        size = np.diff(sources.offsets.to_numpy())
        cells = pd.DataFrame({"run": np.repeat(place, size), "source": sources.flatten().to_pandas(), "n": counts.flatten().to_numpy()})
        cells = cells.groupby(["run", "source"], sort=True)["n"].sum().reset_index()
        n = int(keep.sum())
        size = np.bincount(cells["run"], minlength=n)
        total = np.add.reduceat(cells["n"].to_numpy(), np.concatenate([[0], np.cumsum(size)[:-1]]))
        first = pa.array(starts[keep])
        lang, term = lang.take(first), term.take(first)
        chunk = np.zeros(n, dtype=np.int64)
        names = lang.to_pandas()
        for name in names.unique():
            mine = np.flatnonzero(names == name)
            chunk[mine] = (numbered[name] + np.arange(len(mine))) // CHUNK
            numbered[name] += len(mine)
        lists = _lists(size, pa.array(cells["source"], pa.string())), _lists(size, pa.array(cells["n"], pa.int64()))
        yield pa.RecordBatch.from_arrays([lang, pa.array(chunk + (TaskContext.get().partitionId() << 32)), term, pa.array(total), *lists], ["lang", "chunk", "term", "total", "sources", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves come in order; the last run of a batch waits for the next one."""
        numbered: Counter = Counter()
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch.column("lang"), batch.column("term"))
            same = waiting and all(waiting[-1].column(c)[waiting[-1].num_rows - 1].as_py() == batch.column(c)[0].as_py() for c in ("lang", "term"))
            if same and len(starts) == 1:
                waiting.append(batch)
                continue
            last = int(starts[-1])
            whole = pa.Table.from_batches([*waiting, batch.slice(0, last)])
            if whole.num_rows:
                yield from joined(whole, numbered)
            waiting = [batch.slice(last)]
        if waiting:
            yield from joined(pa.Table.from_batches(waiting), numbered)

    return merge


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def term_counts(docs: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """(lang, chunk, term, total, sources, counts): the terms in at least ``least`` documents of a
    language, with their counts by source, in chunks of up to CHUNK terms in UTF-8 order; stored.

    Null languages, sources and texts are empty strings. Whole texts are counted, whatever their length.
    """
    empty = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    leaves = saved(docs.select(*empty).mapInArrow(_counted, LEAF), "leaves")
    ranged = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return saved(ranged.mapInArrow(_merged(least), KEPT), "kept")


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """Smoothed shares of counts in billionths, from 1 on; total: of the smoothed counts."""
    if counts.size and int(counts.max()) >= (1 << 63) // SCALE - 2:
        return (1 + (counts.astype(object) + 2) * SCALE // total).astype(np.int64)
    return 1 + (counts + 2) * SCALE // total


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _dense(sources: pa.ListArray | pd.Series, counts: pd.Series, names: list[str]) -> np.ndarray:
    """Counts (terms x names); sources that aren't named are left out."""
    size = sources.map(len).to_numpy()
    out = np.zeros((len(sources), len(names)), dtype=np.int64)
    if size.sum():
        flat = np.concatenate([np.asarray(x, dtype=object) for x in sources if len(x)])
        place = pd.Index(names).get_indexer(flat)
        row = np.repeat(np.arange(len(sources)), size)
        n = np.concatenate([np.asarray(x, dtype=np.int64) for x in counts if len(x)])
        some = place >= 0
        out[row[some], place[some]] = n[some]
    return out


FOUND = "part string, lang string, source string, item string, value long"


def _compared(terms_: pd.DataFrame, unit: pd.DataFrame) -> pd.DataFrame:
    """One chunk of terms, two blocks of sources: what each pair of sources gains, and (where a
    block meets itself) each source's first TOP terms of the chunk."""
    out: list[tuple] = []
    if len(terms_) and len(unit):
        u = unit.iloc[0]
        t = terms_.assign(order=terms_["term"].map(str.encode)).sort_values("order")
        smooth = 2 * int(u["terms"])
        blocks = []
        for side in ("a", "b"):
            names, sums = list(u[f"{side}_sources"]), np.asarray(u[f"{side}_sums"], dtype=np.int64)
            counts = _dense(t["sources"], t["counts"], names)
            blocks.append((names, counts, shares(counts, sums + smooth)))
        (names, counts, p), (others, _, q) = blocks
        same = int(u["a"]) == int(u["b"])
        for i, name in enumerate(names):
            start = i + 1 if same else 0
            gained = distance(p[:, i : i + 1], q[:, start:]).sum(axis=0).tolist()
            for other, value in zip(others[start:], gained, strict=True):
                out += [("pair", u["lang"], name, other, value), ("pair", u["lang"], other, name, value)]
        if same:
            lang = shares(t["total"].to_numpy(dtype=np.int64), int(u["total"]) + smooth)
            words = t["term"].tolist()
            for i, name in enumerate(names):
                high = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > lang))
                f = distance(p[high, i], lang[high])
                for k in np.argsort(-f, kind="stable")[:TOP]:  # ties in UTF-8 order
                    out.append(("term", u["lang"], name, words[high[k]], int(f[k])))
    return pd.DataFrame(out, columns=["part", "lang", "source", "item", "value"]).astype({"value": "int64"})


def _blocks(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, terms, total, block, sources, sums): the sources of a language, BLOCK of them a row."""
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # of the sources, not of documents
    numbered = groups.withColumn("block", F.floor(number / BLOCK).cast("int"))
    cell = F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))))  # BLOCK at most
    rows = numbered.join(sums, ["lang", "source"], "left").groupBy("lang", "block").agg(cell.alias("cells"))
    return rows.join(langs, "lang").select("lang", "terms", "total", "block", F.col("cells.source").alias("sources"), F.col("cells.n").alias("sums"))


def _ranked(df: DataFrame, item: Column) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), item))


def divergence(docs: DataFrame, least: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of each language.

    ``pair``: every other source of the language, by the summed distance of their smoothed term
    shares; ``term``: a source's first ``top`` terms (TOP at most) that it has more of than its
    language. A language without kept terms has pairs of value 0 and no terms.

    The work is dealt by chunks of terms and blocks of sources, so neither a large vocabulary
    nor a language with most documents, or with many sources, meets in one task.
    """
    groups = saved(docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct(), "groups")
    kept = term_counts(docs, least)
    blocks = saved(_blocks(kept, groups), "blocks")
    a = blocks.select("lang", "terms", "total", F.col("block").alias("a"), F.col("sources").alias("a_sources"), F.col("sums").alias("a_sums"))
    b = blocks.select("lang", F.col("block").alias("b"), F.col("sources").alias("b_sources"), F.col("sums").alias("b_sums"))
    units = a.join(b, "lang").where("a <= b")  # blocks, not sources
    headers = saved(kept.select("lang", "chunk").distinct().join(units, "lang"), "headers")
    dealt = kept.join(units.select("lang", "a", "b"), "lang")
    key = ["lang", "chunk", "a", "b"]
    found = saved(dealt.groupBy(*key).cogroup(headers.groupBy(*key)).applyInPandas(_compared, FOUND), "found")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("gained"))
    others = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")  # the result's rows
    pairs = others.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("gained", F.lit(0)).cast("long"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", _ranked(pairs, F.col("item")).alias("rank"))
    offered = found.where("part = 'term'")
    ranked = offered.withColumn("rank", _ranked(offered, F.col("item"))).where(F.col("rank") <= min(top, TOP))
    return pairs.unionByName(ranked.select("lang", "source", "part", "item", "value", "rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and leading terms over all of ``documents``.

    Null and empty languages, sources and texts are empty strings, each a group like any other;
    a text without terms counts for nothing but its group. Whole texts are counted, however
    long. Repeated rows are documents each. Ties rank by the item in UTF-8 order. An empty
    table gives an empty result. Other columns aren't used, whatever their names.
    """
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT lang, source, doc, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY w.lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v) AS p,
         1 + (1000000000::HUGEINT * (kept.total + 2)) // (v.total + 2 * v.v) AS q
  FROM g JOIN kept ON g.lang = kept.lang JOIN v ON v.lang = g.lang
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
words AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
