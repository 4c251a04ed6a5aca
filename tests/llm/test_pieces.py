import hashlib
import random

import pytest

from gradeloom.llm import pieces as P
from tests.llm.conftest import same

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "\n\n a  b", "a▁b", "▁", " lead", "trail ", "tab\tx\r\n", "日本語 😀 é", "<s> <unk> <0x41>", "\x00a", "a" * 300, "�"]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" \n\tabcdeé漢😀▁.1") for _ in range(rng.randint(0, 60))) for _ in range(400)]


def test_agenda_is_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    e, xs = P.Encoder(MODEL, check=False), texts()
    ids = e.encode(xs)
    want = sp.encode(xs, num_threads=1)
    assert ids == [",".join(map(str, w)) for w in want]
    assert [e.decode(x) for x in ids] == sp.decode(want, num_threads=1)


def test_memory_may_turn_over(monkeypatch):
    monkeypatch.setattr(P, "MEMORY", 8)
    a, b = P.Encoder(MODEL, check=False), P.Encoder(MODEL, check=False)
    xs = texts()[:60]
    assert [a.encode([x])[0] for x in xs] == b.encode(xs)


def test_a_wrong_merge_is_noticed(monkeypatch):
    monkeypatch.setattr(P, "merge", lambda chunk, v: [5])
    with pytest.raises(AssertionError):
        P.Encoder(MODEL).encode(["some text"])


def test_query_columns(spark, odd_docs, odd_rows, clashing, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in odd_rows:
        ids = sp.encode(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    got = P.token_digests(odd_docs, MODEL)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert same(P.token_digests(clashing, MODEL), got)
    assert P.token_digests(no_docs, MODEL).count() == 0
    full = P.tokens(odd_docs, MODEL).where("doc_id = 9").head()
    assert full["ids"] == sp.encode("one two") and full["decoded"] == "one two"


def test_short_chunks_are_merged_as_long_ones():
    v = P.vocabulary(MODEL)
    chunks = {c.replace(" ", P.SPACE) for t in texts() + ["aaaa" * 9, " the the", " internationalization"] for c in P.CHUNK.findall(" " + t)}
    assert all(P.by_list(c, v) == P.by_heap(c, v) for c in chunks)
    edge = "ab" * (P.SHORT // 2)
    assert [P.by_list(c, v) for c in (edge, edge + "c")] == [P.by_heap(c, v) for c in (edge, edge + "c")]


def test_short_chunks_need_no_heap(monkeypatch):
    monkeypatch.setattr(P.heapq, "heapify", lambda agenda: 1 / 0)
    P.Encoder(MODEL).encode(["some short words"])
    with pytest.raises(ZeroDivisionError):
        P.Encoder(MODEL).encode(["a" * (P.SHORT + 1)])
