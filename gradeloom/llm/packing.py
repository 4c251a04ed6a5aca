"""Best-two-fit packing of token pieces into fixed-length sequences.

Pieces differ only by their length, so the packing is computed on the histogram of
lengths (as many rows as the capacity, whatever the corpus). A bin is filled greedily
with the longest piece that fits; then its smallest piece gives way to two unpacked
pieces that fill its expanded gap more tightly. The finished bin is a pattern, used as
often as the counts allow; so there are a few patterns per length, for any number of
pieces. Pieces are then numbered within their length, and number and length lead to
their place.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table, text_or_empty
from gradeloom.llm.worker import Memory, kept, runs_of, task

CAPACITY = 2048
#: Bytes of words that a tokenizing worker remembers; bytes of text and words that it encodes at once.
MEMORY, BYTES, WORDS = 256 << 20, 4_000_000, 4_000
#: Words whose ids are put in order at once.
RUN = 1 << 17
#: Rows of one length that are numbered in one task.
BLOCK_ROWS = 50_000


#: Letters and numbers among the characters that the fast split takes: those that
#: normalisation leaves alone but for case, and whose case doesn't depend on neighbours.
LETTERS = r"a-zA-Z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u012F\u0131-\u024F"
#: Letters that some of those become in lower case.
LOWERED = r"\u0250-\u02AF\u2C65\u2C66"
NUMBERS = r"0-9\xB2\xB3\xB9\xBC-\xBE"
PLAIN = re.compile(r"[\x21-\x3B\x3D-\x7E\xA1-\u012F\u0131-\u024F]*")
#: The tokenizer file's own split, over those characters without blanks and ``<``.
OWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}{LOWERED}]+|[{NUMBERS}]|[^{LETTERS}{LOWERED}{NUMBERS}]+")
#: Marks between a letter or digit and a blank are a part of that split, as no apostrophe is among them.
MARKS = "!#$%&*,.:;?"
MARKED = "([0-9" + LETTERS.encode().decode("unicode_escape") + f"])([{MARKS}]+)(?: |$)"
#: The character that stands for a byte in a byte-level model: its own if it is visible.
HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(HIDDEN)}


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Where the tokenizer's own split drops blanks and newlines, they always separate tokens,
    so a text is encoded word by word, marks after a word apart: each distinct word of some texts
    is looked up once, and words are remembered. A new word of plain characters falls into the parts of that split,
    which are words of their own, known or encoded once each by the library's model; other
    words go to the library whole. With any other tokenizer, the library encodes whole texts.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = kind["pre_tokenizer"]["pretokenizers"] if kind["pre_tokenizer"] and kind["pre_tokenizer"]["type"] == "Sequence" else []
        own = steps[0]["pattern"].get("Regex", "") if steps and steps[0]["type"] == "Split" else ""
        names = [n["type"] for n in (kind["normalizer"] or {}).get("normalizers", [])]
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.split = own == OWN_SPLIT and names == ["NFC", "Replace", "Lowercase"]
        # parts go to the model as they are, in its characters for bytes
        self.split = self.split and len(steps) == 2 and level.items() <= steps[1].items() and kind["model"]["type"] == "BPE"
        # a special token inside a word comes first
        self.split = self.split and all("<" in t["content"] and not set(MARKS) & set(t["content"]) for t in kind.get("added_tokens", []))
        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory(MEMORY)

    def _library(self, texts: list[str]) -> dict[str, bytes]:
        return {
            t: np.asarray(e.ids, dtype="<u4").tobytes()
            for at in range(0, len(texts), WORDS)
            for t, e in zip(texts[at : at + WORDS], self.tokenizer.encode_batch_fast(texts[at : at + WORDS], add_special_tokens=False), strict=True)
        }

    def _model(self, parts: list[str]) -> dict[str, bytes]:
        """The same for parts of the split, which need neither normalisation nor a split."""
        tokenize, ids, ends = self.tokenizer.model.tokenize, [], []
        for p in parts:
            ids += [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARS))]
            ends.append(4 * len(ids))
        raw = np.asarray(ids, dtype="<u4").tobytes()
        return {p: raw[a:b] for p, a, b in zip(parts, [0, *ends], ends, strict=False)}

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        memory = self.memory
        single, whole, parts = set(), [], {}
        for w in memory.missing(words):
            if w.isascii() and w.isalpha() and w.islower():
                single.add(w)
            elif PLAIN.fullmatch(w):
                parts[w] = SPLIT.findall(w.lower())
            else:
                whole.append(w)
        memory.add(self._model(list(single.union(memory.missing(chain.from_iterable(parts.values()))))))
        memory.add(self._library(whole))
        known = memory.new
        memory.add({w: b"".join(map(known.__getitem__, p)) for w, p in parts.items()})
        out = [known[w] for w in words]
        memory.turn()
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not self.split:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            known = self._library(texts)
            return [known[t] for t in texts]
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        apart = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), MARKED, r"\1 \2 ")
        split = pc.split_pattern(apart, " ")
        words = split.flatten().dictionary_encode()
        found = self._words(words.dictionary.to_pylist())
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        first = np.cumsum(length) - length
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        word = words.indices.to_numpy()
        runs = []
        for at in range(0, len(word), RUN):
            some = word[at : at + RUN]
            n = length[some]
            ends = np.cumsum(n)
            runs.append(ids[np.repeat(first[some] - ends + n, n) + np.arange(n.sum())].tobytes())
        raw = b"".join(runs)
        before = np.concatenate([[0], np.cumsum(length[word])]) * 4
        bounds = before[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])].tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as bytes): a document's tokens and
    the end id, cut at multiples of the capacity if longer."""
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task():
            yield from coded(kept(WordIds, tokenizer), batches)

    def coded(coder: WordIds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(end_id).to_bytes(4, "little")
        for whole in batches:
            for at, to in runs_of(pc.binary_length(whole.column(1)).to_pylist(), BYTES):
                batch = whole.slice(at, to - at)
                row, cols = [], [[] for _ in kinds]
                for i, ids in enumerate(coder.encode(batch.column(1))):
                    ids += end
                    for k, p in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[p : p + 4 * capacity]
                        row.append(i)
                        for c, v in zip(cols, (k, p // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)]],
                    names=["doc_id", *kinds],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, f"doc_id {kind}, {PIECE}" + (", ids binary" if with_ids else ""))


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), covering every piece exactly once.

    counts: pieces per length, 1 to capacity.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] = n
    #: for each length, the longest available one that is no longer
    out = []

    def longest(limit: int) -> int:
        """The longest available length of at most ``limit``; 0 if none."""
        limit = min(limit, capacity)
        if limit < 1:
            return 0
        if left[limit] > 0:
            return limit
        some = np.flatnonzero(left[1 : limit + 1] > 0)
        return int(some[-1]) + 1 if len(some) else 0

    def best_two(limit: int) -> tuple[int, int]:
        """Two available pieces with the largest total of at most ``limit``; zeros if none."""
        have = np.flatnonzero(left[: max(limit, 0) + 1] > 0)
        have = have[have > 0]
        if not len(have):
            return 0, 0
        at = np.searchsorted(have, limit - have, side="right") - 1
        ok = at >= 0
        a, b = have[ok], have[at[ok]]
        # a length can pair with itself only if two are left; else with the next shorter one
        alone = (a == b) & (left[a] < 2)
        down = at[ok] - 1
        b = np.where(alone, np.where(down >= 0, have[np.maximum(down, 0)], 0), b)
        ok = b > 0
        a, b = a[ok], b[ok]
        if not len(a):
            return 0, 0
        i = int((a + b).argmax())
        return int(a[i]), int(b[i])

    while (first := longest(capacity)) > 0:
        bin_, gap = [first], capacity - first
        left[first] -= 1
        while gap > 0 and (x := longest(gap)):
            bin_.append(x)
            left[x] -= 1
            gap -= x
        while gap > 0 and len(bin_) > 1:
            small = bin_[-1]
            x, y = best_two(gap + small)
            if x + y <= small:
                break
            bin_.pop()
            left[small] += 1
            left[x] -= 1
            left[y] -= 1
            bin_ += sorted((x, y), reverse=True)
            gap += small - x - y
            bin_.sort(reverse=True)
        use = Counter(bin_)
        times = 1 + min(int(left[x]) // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= (times - 1) * n
        out.append((bin_, times))
    return out


def places(found: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, runs of piece numbers: (first number, per bin, first sequence, offset, step).

    The pieces number..number + per_bin * times - 1 of a length go to ``times`` bins.
    """
    next_number: Counter[int] = Counter()
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for bin_, times in found:
        at = 0
        for x, n in sorted(Counter(bin_).items(), reverse=True):
            runs.setdefault(x, []).append((next_number[x], n, sequence, at))
            next_number[x] += n * times
            at += n * x
        sequence += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in runs.items()}


def numbered(pieces: DataFrame, counts: dict[int, int], row: str) -> DataFrame:
    """Adds number: gapless from 0 within each length. ``row`` tells all rows apart.

    Every length is dealt by hash into blocks of about a task's share of the rows,
    BLOCK_ROWS at most; a block is numbered in one task and starts where the blocks
    before it end.
    """
    spread = F.xxhash64(row)
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(BLOCK_ROWS, max(1, sum(counts.values()) // tasks))
    blocks = max(1, -(-max(counts.values(), default=0) // share))
    dealt = pieces.withColumn("_block", F.pmod(spread, F.lit(blocks)))
    sizes = dealt.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("length").alias("_length"), F.col("_block").alias("_of"), F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("length", "_block").orderBy(row)) - 1
    ranked = dealt.withColumn("_inside", inside)
    joined = ranked.join(starts, (F.col("length") == F.col("_length")) & (F.col("_block") == F.col("_of")))
    return joined.withColumn("number", F.col("_start") + F.col("_inside")).drop("_block", "_length", "_of", "_start", "_inside")


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (doc_id, piece, length, ids_crc32 ..).

    No piece is dropped, and no sequence is longer than the capacity. _row, which tells the
    pieces apart, goes.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one row per length
    runs = places(patterns(counts, capacity))
    rows = numbered(pieces, counts, "_row")
    names = [c for c in rows.columns if c not in ("number", "_row")]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("number", "length"))
            seq, off = np.zeros((2, batch.num_rows), dtype=np.int64)
            for x in np.unique(length):
                here = np.flatnonzero(length == x)
                first, per, sequence, at = runs[int(x)]
                i = np.searchsorted(first, number[here], side="right") - 1
                k = number[here] - first[i]
                seq[here] = sequence[i] + k // per[i]
                off[here] = at[i] + (k % per[i]) * x
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id bigint, offset bigint"
    return rows.mapInArrow(put, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is the end id alone; a very long one is cut into as many pieces
    as it needs, none dropped. Ties (pieces of one length) are numbered by a hash of the row.
    Repeated rows are packed each; an empty table gives an empty result; other columns are
    not used, whatever their names. Sequences are numbered from 0 without gaps.
    """
    pieces = token_pieces(docs, tokenizer, capacity).withColumn("_row", F.monotonically_increasing_id())
    return packed(saved(pieces, "pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
