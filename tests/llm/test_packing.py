import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gradeloom.llm import packing as P
from tests.llm.conftest import same

FILE = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def test_words_are_the_library():
    rng = random.Random(1)
    xs = ["", " ", "\n", "<|endoftext|> a<|startoftext|>b", "é ́x", "İstanbul ΑΣ", "it's 'string ''s x.'s don't ½² a_b ÀÉ ŉ ǅ Ĳ"]
    xs += ["".join(rng.choice(" \n\tabcdeéÉŉǅ½²_Z.1's<漢Σ́") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    coder = P.WordIds(FILE)
    assert coder.split
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(xs)]
    assert got == [e.ids for e in library().encode_batch(xs, add_special_tokens=False)]


def test_words_are_looked_up_once(monkeypatch):
    """Each distinct word of some texts is looked up once, and plain ones need no normalisation or split."""
    xs = ["The cat, the dog. É2 été\n" * 500, "the cat " * 700]
    coder, asked = P.WordIds(FILE), []
    missing = coder.memory.missing
    monkeypatch.setattr(coder.memory, "missing", lambda words: missing(asked.extend(words := list(words)) or words))
    coder.tokenizer = type("Model", (), {"model": coder.tokenizer.model})()  # without encode
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(xs)]
    assert got == [e.ids for e in library().encode_batch(xs, add_special_tokens=False)]
    assert len(asked) < 30


def test_marks_after_words_are_words_of_their_own():
    xs = ["ab. ab, ab! été.\nété; été### 12. 12", "it's. 's.'s !'s. a<. <|endoftext|>. a|. e\u0301. a.\u0301 a.\tb. . a.b"]
    coder = P.WordIds(FILE)
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(xs)]
    assert got == [e.ids for e in library().encode_batch(xs, add_special_tokens=False)]
    assert not {"ab.", "ab,", "été.", "été###", "12."} & set(coder.memory.new)


def test_letters_whose_lower_case_lies_further():
    xs = [f"a{chr(c)}\xa2{chr(c)}1{chr(c)}." for c in range(0xA1, 0x250)] + ["ƆKƐ Əli ¢Ɔ Ⱥ¢Ⱦ"]
    got = [np.frombuffer(x, "<u4").tolist() for x in P.WordIds(FILE).encode(xs)]
    assert got == [e.ids for e in library().encode_batch(xs, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 7, 300, 5000])
def test_patterns_cover_every_piece_once(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(64, rng.lognormal(2.5, 1, n).astype(int) + 1)
    counts = Counter(lengths.tolist())
    found = P.patterns(counts, 64)
    got = Counter()
    for bin_, times in found:
        assert sum(bin_) <= 64 and times >= 1
        for x in bin_:
            got[x] += times
    assert got == counts
    bins = sum(t for _, t in found)
    assert bins <= -(-int(lengths.sum()) // 64) * 1.02 + 1


def test_two_replace_one():
    # greedy alone: 60 + 30 leaves 10; two of 20 fill it
    found = P.patterns({60: 1, 30: 1, 20: 2}, 100)
    assert sorted(found[0][0]) == [20, 20, 60]


def check(got, texts):
    """got: rows of the query; texts: the documents' texts."""
    tk = library()
    want = Counter()
    for doc, t in texts:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        for i, p in enumerate(range(0, len(ids), P.CAPACITY)):
            part = np.asarray(ids[p : p + P.CAPACITY], "<u4")
            want[(doc, i, p, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= P.CAPACITY
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // P.CAPACITY) * 1.05 + 1


def test_query(spark, odd_docs, odd_rows, clashing, no_docs, monkeypatch):
    check(P.pack_documents(odd_docs, FILE).collect(), [r[:2] for r in odd_rows])
    assert P.pack_documents(no_docs, FILE).count() == 0
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert same(P.pack_documents(clashing, FILE).select(*key), P.pack_documents(odd_docs, FILE).select(*key))
    monkeypatch.setattr(P, "BLOCK_ROWS", 2)  # many blocks of a length
    check(P.pack_documents(odd_docs, FILE).collect(), [r[:2] for r in odd_rows])
