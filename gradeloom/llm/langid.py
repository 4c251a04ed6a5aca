"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language is turned into a suffix automaton.
A text is parsed greedily against each automaton: a phrase grows while the automaton
has a transition, so every phrase is a longest match with the labelled text. The
phrases, times the logarithm of the sample's length and over the text's length,
estimate the cross entropy; the language with the least estimate wins.

The parse runs in lock step over many blocks of text at once. A block is first parsed as
if it opened a phrase; then those that continue a text are parsed again from the state
in which the block before them ended, until both parses are in the same state, from
where they are one. So phrases run over the blocks' borders, as in one parse of the
whole text.

The automata's transitions are sparse: rows of a table displaced into each other, so
that memory grows with the samples, not with the alphabets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import table, text_or_empty
from gradeloom.llm.worker import task

#: Characters that are stepped through at once in a text.
BLOCK = 1024
#: Characters that are stepped at once in a worker.
BATCH_CHARS = 2_000_000
LOW = (1 << 32) - 1


def folded(text: str) -> str:
    """Lower case; every character but a letter becomes a blank."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    edges: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return edges


@dataclass
class Model:
    """langs; codes: code point -> column of an alphabet of all languages; the transitions.

    cells[base[state] + column] holds the state that owns the cell and, below, the next
    state; if another state owns it, there is no transition, and a phrase opens with
    first[column, language]. start: the state of each language before a text.
    """

    langs: list[str]
    codes: np.ndarray
    base: np.ndarray
    cells: np.ndarray
    first: np.ndarray
    start: np.ndarray
    scale: np.ndarray


def displaced(owner: np.ndarray, column: np.ndarray, states: int, width: int) -> tuple[np.ndarray, int]:
    """(base per state, number of cells): base + column is another cell for every transition.

    States with many transitions come first; those with one fill what is left. Places are
    tried at random, all states with equally many transitions at once.
    """
    rng = np.random.default_rng(7)
    base = np.zeros(states, dtype=np.int64)
    size = len(owner) * 3 // 2 + 2 * width
    free = np.ones(size, dtype=bool)
    claim = np.zeros(size, dtype=np.int64)
    order = np.argsort(owner, kind="stable")
    owner, column = owner[order], column[order]
    degree = np.bincount(owner, minlength=states)
    at = np.cumsum(degree) - degree
    for d in sorted(set(degree[degree > 1].tolist()), reverse=True):
        rest = np.flatnonzero(degree == d)
        while len(rest):
            try_ = rng.integers(0, size - width, len(rest))
            slots = try_[:, None] + column[at[rest][:, None] + np.arange(d)]
            claim[slots] = rest[:, None]
            won = free[slots].all(axis=1) & (claim[slots] == rest[:, None]).all(axis=1)
            free[slots[won]] = False
            base[rest[won]] = try_[won]
            rest = rest[~won]
    one = np.flatnonzero(degree == 1)
    base[one] = np.flatnonzero(free[width:])[: len(one)] + width - column[at[one]]
    return base, size + width


def train(samples: dict[str, str]) -> Model:
    """A model from labelled text per language (see ``folded``)."""
    langs = sorted(samples)
    texts = [folded(samples[x]) for x in langs]
    alphabet = sorted(set("".join(texts)) - {" "})
    width = len(alphabet) + 2  # blank, letters, letters never seen
    column = {" ": 0} | {c: i + 1 for i, c in enumerate(alphabet)}
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    codes = np.where(letter, width - 1, 0).astype(np.int32)
    for c, i in column.items():
        codes[ord(c)] = i
    rows: list[tuple[int, int, int]] = []
    start, offsets, roots, at = [], [], [], 0
    for text in texts:
        edges = suffix_automaton(text)
        rows += [(s + at, column[c], to + at) for s, out in enumerate(edges) for c, to in out.items()]
        roots.append(edges[0])
        offsets.append(at)
        start.append(at + len(edges))  # before a text and behind an unseen letter: whatever comes opens a phrase
        at += len(edges) + 1
    if at > LOW >> 1:
        raise ValueError("the samples are too long")
    first = np.tile(np.array(start, dtype=np.int64), (width, 1))
    for k, root in enumerate(roots):
        for c, to in root.items():
            first[column[c], k] = to + offsets[k]
    owner, cols, to = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else np.zeros((3, 0), dtype=np.int64)
    base, size = displaced(owner, cols, at, width)
    cells = np.full(size, -1, dtype=np.int64)
    cells[base[owner] + cols] = owner << 32 | to
    scale = np.array([np.log2(max(len(t), 2)) for t in texts])
    return Model(langs, codes, base, cells, first, np.array(start, dtype=np.int64), scale)


def coded(text: str, model: Model) -> np.ndarray:
    """Columns of the characters of a text; every non-letter is a blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return model.codes[points]


def _letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def _step(model: Model, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next states, whether they open a phrase) of rows of states, one column each."""
    cell = model.cells[model.base[state] + column[:, None]]
    opens = cell >> 32 != state
    return np.where(opens, model.first[column], cell & LOW), opens


def phrases(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrase counts (texts x languages) of coded texts."""
    cut = [(i, c[p : p + BLOCK], p > 0) for i, c in enumerate(texts) for p in range(0, len(c), BLOCK)]
    n, k = len(cut), len(model.langs)
    size = np.array([len(b) for _, b, _ in cut], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    size = size[order]
    longest = int(size.max(initial=0))
    grid = np.zeros((longest, n), dtype=np.int32)
    for j, (_, b, _) in zip(place, cut, strict=True):
        grid[: len(b), j] = b
    # every block as if it opened a phrase
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    end = np.repeat(model.start[None, :], n, axis=0)
    count = np.zeros((n, k), dtype=np.int64)
    for t in range(longest):
        m = alive[t]
        end[:m], opens = _step(model, end[:m], grid[t, :m])
        count[:m] += opens
    # those that continue a text from the state before them; again where that state changes
    before = np.full(n, -1, dtype=np.int64)
    after = np.full(n, -1, dtype=np.int64)
    for i, (_, _, more) in enumerate(cut):
        if more:
            before[place[i]], after[place[i - 1]] = place[i - 1], place[i]
    fresh, fresh_end = count.copy(), end.copy()
    todo = np.flatnonzero(before >= 0)
    while len(todo):
        diff, last = _resumed(grid, size, todo, end[before[todo]], fresh_end[todo], model)
        count[todo] = fresh[todo] + diff
        changed = todo[(last != end[todo]).any(axis=1)]
        end[todo] = last
        todo = after[changed]
        todo = todo[todo >= 0]
    out = np.zeros((len(texts), k), dtype=np.int64)
    np.add.at(out, np.array([i for i, _, _ in cut], dtype=np.int64), count[place])
    return out


def _resumed(grid: np.ndarray, size: np.ndarray, rows: np.ndarray, begin: np.ndarray, fresh_end: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(difference of the counts, end states) of blocks that begin in given states, against
    those that open a phrase; a row ends where both parses are in the same states."""
    mine, fresh = begin.copy(), np.repeat(model.start[None, :], len(rows), axis=0)
    diff, last = np.zeros(begin.shape, dtype=np.int64), fresh_end.copy()
    live, t = np.flatnonzero((mine != fresh).any(axis=1)), 0
    while len(live):
        column = grid[t, rows[live]]
        mine[live], a = _step(model, mine[live], column)
        fresh[live], b = _step(model, fresh[live], column)
        diff[live] += a.astype(np.int64) - b
        t += 1
        over = size[rows[live]] == t
        last[live[over]] = mine[live[over]]
        live = live[~over & (mine[live] != fresh[live]).any(axis=1)]
    return diff, last


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """The winning language and the margin (0 to 1) over the runner-up.

    und and 0 for a null, a text without a letter, or where no language is learned.
    Ties go to the first language by name, with margin 0.
    """
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    todo: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        bits = phrases([c for _, c in todo], model) * model.scale
        for (i, _), row in zip(todo, bits, strict=True):
            best = int(row.argmin())
            langs[i] = model.langs[best]
            rest = np.delete(row, best)
            scores[i] = float(1 - row[best] / rest.min()) if len(rest) else 1.0
        todo.clear()

    held = 0
    for i, text in enumerate(texts):
        if not model.langs or text is None or not _letters(text):
            continue
        c = coded(text, model)
        todo.append((i, c))
        held += len(c)
        if held >= BATCH_CHARS:
            flush()
            held = 0
    if todo:
        flush()
    return langs, scores


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, sample_chars: int = 40_000, sample_docs: int = 64) -> dict[str, str]:
    """At most ``sample_chars`` characters of labelled text per language.

    Of each language, one text (that with the least hash) is taken from each of
    ``sample_docs`` hash buckets, so copies count once and whole texts are used until
    the bound is met. Only bounded rows reach the driver: sample_docs per language.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    least = hashed.groupBy("lang", F.pmod("h", F.lit(sample_docs)).alias("bucket")).agg(F.min("h").alias("h"))
    wanted = [(r["lang"], r["h"]) for r in least.collect()]
    if not wanted:
        return {}
    picked = hashed.where(F.col("h").isin([h for _, h in wanted])).groupBy("lang", "h").agg(F.first(F.substring("text", 1, sample_chars)).alias("text"))
    found: dict[str, list[tuple[int, str]]] = {}
    keep = set(wanted)
    for r in picked.collect():
        if (r["lang"], r["h"]) in keep:
            found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return {lang: "\n".join(t for _, t in sorted(parts))[:sample_chars] for lang, parts in found.items()}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to the rows of ``docs`` (columns of those names are replaced)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # some 40 bytes a character of the bounded samples, and the alphabet's columns

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with task():
            m = shared.value
            for texts in parts:
                lang, score = predict([None if t is None or t != t else t for t in texts], m)
                yield pd.DataFrame({"lang_pred": lang, "score": score})

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    got = docs.select(*[F.col(f"`{c}`") for c in names], judge(F.col("text")).alias("_judged"))
    return got.select(*[F.col(f"`{c}`") for c in names], "_judged.lang_pred", "_judged.score")


def language_id(docs: DataFrame, sample_chars: int = 40_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``.

    lang and doc_id only choose the training sample; a prediction sees the text alone, the
    whole of it however long. Null and letterless texts give und with score 0; so does
    everything if no row is labelled. Languages that tie give the first by name, with score
    0. Repeated rows are judged each; an empty table gives an empty result; other columns
    are not used, whatever their names.
    """
    own = docs.select("doc_id", "text", "lang")
    model = train(labelled_sample(own, sample_chars))
    got = identify(own.select("doc_id", "text", held_out().alias("held_out")), model)
    return got.select("doc_id", "held_out", "lang_pred", "score")


def filter_language(docs: DataFrame, sample_chars: int = 40_000, least_score: float = 0.01) -> DataFrame:
    """The rows whose language is identified with a margin of ``least_score`` or more.

    If nothing is labelled, no language can be learned and every row with a letter stays.
    Null and letterless texts go; long ones are judged whole; repeated rows are judged each;
    an empty table stays empty; columns may have any names.
    """
    model = train(labelled_sample(docs.select("doc_id", "text", "lang"), sample_chars))
    if not model.langs:
        return docs.where(text_or_empty().rlike(r"\p{L}"))
    names = docs.columns
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    got = identify(packed, model)
    return got.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("_row.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


