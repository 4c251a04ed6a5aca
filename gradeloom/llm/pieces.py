"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder is an agenda: adjacent symbol pairs whose concatenation is a piece, taken
by score (best first, then leftmost), until none is left; a list for short chunks, a
heap for long ones. A text falls apart where no
piece can reach across, so each distinct chunk is encoded once per worker and checked
against the sentencepiece library in the batch in which it first appears.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from math import inf
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import table, text_or_empty
from gradeloom.llm.worker import Memory, kept, slices, task

SPACE = "▁"
#: Piece kinds of the model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of chunks that a worker remembers; characters that it encodes at once.
MEMORY, CHARS = 160 << 20, 1_000_000
#: Characters of a chunk up to which looking through all pairs is quicker than a heap of them.
SHORT = 64


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: varints, 4-byte and length-delimited values."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, buf[at : at + n]
            at += n
        else:
            n = varint()
            yield tag >> 3, buf[at : at + n]
            at += n


class Vocabulary:
    """Pieces of a merge-type model without a normalisation table."""

    def __init__(self, path: str):
        import struct

        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.rank: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        spec = {"model": 1, "prefix": True, "strip": True, "escape": True, "table": b"", "suffix": False, "fallback": False}
        for no, value in _fields(raw):
            if no == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                i = len(self.pieces)
                self.pieces.append(piece)
                self.kinds.append(kind)
                if kind == NORMAL:
                    self.rank[piece] = (-score, i)
                elif kind == BYTE:
                    self.bytes[int(piece[3:5], 16)] = i
                elif kind == UNKNOWN:
                    self.unknown = i
            elif no == 2:
                for k, v in _fields(value):
                    if k == 3:
                        spec["model"] = v
                    elif k == 24:
                        spec["suffix"] = bool(v)
                    elif k == 35:
                        spec["fallback"] = bool(v)
            elif no == 3:
                for k, v in _fields(value):
                    name = {2: "table", 3: "prefix", 4: "strip", 5: "escape"}.get(k)
                    if name:
                        spec[name] = v if name == "table" else bool(v)
        if spec["model"] != 2 or spec["table"] or spec["strip"] or spec["suffix"] or not spec["escape"] or not spec["prefix"] or not spec["fallback"] or {USER, UNUSED} & set(self.kinds):
            raise ValueError("only merge-type vocabularies with an identity normaliser, a dummy prefix and byte fallback are supported")
        inner = [p for p in self.rank if SPACE in p.lstrip(SPACE)]
        newline = [p for p in self.rank if "\n" in p]
        if inner or newline:
            raise ValueError("a piece reaches across chunks")
        self.ids = {p: i for p, (_, i) in self.rank.items()}
        self.score = {p: s for p, (s, _) in self.rank.items()}
        #: what an id stands for in a decoded text, by the id's decimal digits
        self.spelled = {}
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            text = p.replace(SPACE, " ").encode() if k == NORMAL else b" \xe2\x81\x87 " if k == UNKNOWN else b""
            self.spelled[str(i)] = bytes([int(p[3:5], 16)]) if k == BYTE else text


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge(chunk: str, v: Vocabulary) -> list[int]:
    """Ids of a chunk in which blanks are already escaped."""
    ids: list[int] = []
    for s in (by_list if len(chunk) <= SHORT else by_heap)(chunk, v):
        if (i := v.ids.get(s)) is not None:
            ids.append(i)
        else:
            ids += [v.bytes[b] for b in s.encode()]
    return ids


def by_list(chunk: str, v: Vocabulary) -> list[str]:
    """The symbols that are left, with the agenda as a list of the pairs' scores from left to right."""
    get = v.score.get
    sym = list(chunk)
    agenda = list(map(get, map(add, sym, sym[1:]), repeat(inf)))
    while agenda and (best := min(agenda)) < inf:
        i = agenda.index(best)
        del agenda[i]
        whole = sym[i] = sym[i] + sym.pop(i + 1)
        if i < len(agenda):
            agenda[i] = get(whole + sym[i + 1], inf)
        if i:
            agenda[i - 1] = get(sym[i - 1] + whole, inf)
    return sym


def by_heap(chunk: str, v: Vocabulary) -> list[str]:
    """The same with a heap, which takes a long chunk's n symbols n log n steps."""
    rank = v.rank
    sym = list(chunk)
    n = len(sym)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda = []
    for i in range(n - 1):
        if r := rank.get(sym[i] + sym[i + 1]):
            agenda.append((r[0], i, sym[i] + sym[i + 1], i + 1))
    heapq.heapify(agenda)
    while agenda:
        _, i, whole, j = heapq.heappop(agenda)
        # gone if either symbol was merged meanwhile
        if sym[i] is None or sym[j] is None or after[i] != j or len(sym[i]) + len(sym[j]) != len(whole):
            continue
        sym[i], sym[j] = whole, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if r := rank.get(whole + sym[k]):
                heapq.heappush(agenda, (r[0], i, whole + sym[k], k))
        h = before[i]
        if h >= 0 and (r := rank.get(sym[h] + whole)):
            heapq.heappush(agenda, (r[0], h, sym[h] + whole, i))
    return [s for s in sym if s is not None]


#: A newline alone; blanks with what follows them; the rest up to a blank or newline.
CHUNK = re.compile(r"\n|[ ▁]+[^ ▁\n]*|[^ ▁\n]+")


class Encoder:
    """Encodes texts; remembers chunks as the decimal ids, joined by commas.

    Every chunk is checked against the library when it is learned, ids and decoding; what a
    text decodes to is checked against the text itself.
    """

    def __init__(self, path: str, check: bool = True):
        self.v = vocabulary(path)
        self.memory = Memory(MEMORY)
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.newline = self.library.encode("\n")

    def _check(self, chunks: list[str], got: list[list[int]], joined: list[str]) -> None:
        """The library puts one blank before every text: a chunk that starts with one is
        encoded without it; any other one behind a newline, whose ids come first."""
        ahead = [c[0] in " ▁" and len(c) > 1 for c in chunks]
        asked = [c[1:] if a else "\n" + c for c, a in zip(chunks, ahead, strict=True)]
        for c, a, g, want in zip(chunks, ahead, got, self.library.encode(asked, num_threads=1), strict=True):
            if (g if a else self.newline + g) != want:
                raise AssertionError(f"the library encodes {c!r} as {want}, the agenda as {g}")
        for c, mine, want in zip(chunks, map(self.decode, joined), self.library.decode(got, num_threads=1), strict=True):
            if mine != want:
                raise AssertionError(f"the library decodes the ids of {c!r} as {want!r}, not as {mine!r}")

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, in decimal, joined by commas ('' for an empty one)."""
        parts = [CHUNK.findall(" " + t) if t else [] for t in texts]
        memory = self.memory
        missing = memory.missing(chain.from_iterable(parts))
        got = [merge(c.replace(" ", SPACE), self.v) for c in missing]
        joined = [",".join(map(str, g)) for g in got]
        if self.library is not None and missing:
            self._check(missing, got, joined)
        memory.add(dict(zip(missing, joined, strict=True)))
        get = memory.new.__getitem__
        out = [",".join(map(get, p)) for p in parts]
        memory.turn()
        return out

    def decode(self, ids: str) -> str:
        """The text of ids in that form: byte pieces joined as UTF-8, without the blank put in front."""
        if not ids:
            return ""
        raw = b"".join(map(self.v.spelled.__getitem__, ids.split(",")))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def coded(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids, decoded) of each text, a few texts at a time: their chunks take several
        times the texts' memory."""
        for at, to in slices(texts, CHARS):
            for t, ids in zip(texts[at:to], self.encode(texts[at:to]), strict=True):
                back = self.decode(ids)
                if self.library is not None and back != t and back != t.replace(SPACE, " "):
                    raise AssertionError("a text isn't what its ids decode to")
                yield ids, back


def tokens(docs: DataFrame, model: str, check: bool = True) -> DataFrame:
    """doc_id, ids (array<int>), decoded: one row per row of ``docs``; null texts count as empty."""
    return _run(docs, model, check, full=True)


def _run(docs: DataFrame, model: str, check: bool, full: bool) -> DataFrame:
    schema = "ids array<int>, decoded string" if full else "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    @F.pandas_udf(f"struct<{schema.replace(' array', ': array').replace(' string', ': string').replace(' bigint', ': bigint')}>")
    def code(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with task():
            e = kept(Encoder, model, check)
            for texts in parts:
                rows = [row(*x) for x in e.coded(texts.tolist())]
                yield pd.DataFrame(rows, columns=["ids", "decoded"] if full else ["n_tokens", "ids_sha256", "decoded_sha256"])

    def row(x: str, back: str) -> tuple:
        if full:
            return [int(i) for i in x.split(",")] if x else [], back
        return x.count(",") + 1 if x else 0, hashlib.sha256(x.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    return docs.select("doc_id", code(text_or_empty()).alias("_coded")).select("doc_id", "_coded.*")


def token_digests(docs: DataFrame, model: str, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of ``docs``.

    Null texts count as empty: no ids, digests of the empty string. Very long texts are
    encoded whole. Ties between pairs go to the leftmost. Repeated rows give repeated
    results; an empty table an empty one; other columns are not used, whatever their names.
    """
    return _run(docs, model, check, full=False)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
