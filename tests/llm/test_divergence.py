import random
from collections import Counter

import pytest

from gradeloom.llm import divergence as D
from tests.llm.conftest import DOCS, prose


def brute(rows, least=10):
    """Plain loops over whole numbers."""
    import re

    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for _, text, lang, source, *_ in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        found = Counter(t for *_, words in mine for t in set(words))
        kept = [t for t, n in found.items() if n >= least]
        count = {}
        for _, source, words in mine:
            count.setdefault(source, Counter()).update(words)
        whole = sum(count.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: {t: share(c, t) for t in kept} for s, c in count.items()}
        q = {t: share(whole, t) for t in kept}
        for s in count:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s)
            words = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] > 0 and p[s][t] > q[t])[:10]
            for part, found_ in (("pair", pairs), ("term", words)):
                out.update((lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found_))
    return out


def rows_of(df):
    return Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(odd_rows):
    rng = random.Random(11)
    words = [prose(rng, 1, "abcXYé") for _ in range(150)] + ["日本", "ﬀ", "É", "a1b", "x_y", "Ab-Cd"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40), weights=range(1, len(words) + 1))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None, ""])) for i in range(150)]
    return [*[(*r, 0) for r in rows], *odd_rows, (9, None, "it", "a", 0), (9, "", "it", None, 0), (9, "x", "it", "Z", 0)]


@pytest.mark.parametrize(("leaves", "chunk", "block"), [(100_000, 4096, 256), (20, 7, 2)])
def test_against_plain_loops(spark, corpus, monkeypatch, leaves, chunk, block):
    """Also with tries that move on often, chunks of a few terms and blocks of two sources."""
    for name, value in (("LEAVES", leaves), ("CHUNK", chunk), ("BLOCK", block)):
        monkeypatch.setattr(D, name, value)
    assert rows_of(D.divergence(spark.createDataFrame(corpus, DOCS))) == brute(corpus)


def test_against_sql(spark, corpus, tmp_path):
    import duckdb

    df = spark.createDataFrame(corpus, DOCS)
    df.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    found = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({D.ORACLE})").fetchall()
    assert Counter(found) == brute(corpus)


def test_no_rows_and_clashing_names(spark, corpus, no_docs, clashing, odd_docs):
    assert D.divergence(no_docs).count() == 0
    assert rows_of(D.divergence(clashing)) == rows_of(D.divergence(odd_docs))
    assert rows_of(D.divergence(spark.createDataFrame(corpus, DOCS), top=3)) == Counter({k: n for k, n in brute(corpus).items() if k[2] == "pair" or k[5] <= 3})


def test_trie():
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 9))).encode() for _ in range(600)]
    one, two = D.Trie(), D.Trie()
    for i, w in enumerate(words):
        leaf = (one if i % 3 else two).leaf(w)
        leaf.documents += 1
        leaf.sources["s"] = leaf.sources.get("s", 0) + 2
    one.merge(two)
    want = Counter(words)
    assert [(t, x.documents, x.sources) for t, x in one.walk()] == [(t, want[t], {"s": 2 * want[t]}) for t in sorted(want)]
    assert one.leaves.keys() == want.keys()

    def labels(node):
        for first, (label, below) in node[0].items():
            assert label[0] == first and (below[1] is not None or len(below[0]) > 1)  # no edge that could be one with the next
            labels(below)

    labels(one.root)


def test_shares_are_exact_beyond_longs():
    import numpy as np

    big = np.array([[5 * 10**11, 3]])
    assert D.shares(big, 10**12).tolist() == [[1 + (5 * 10**11 + 2) * 10**9 // 10**12, 1 + 5 * 10**9 // 10**12]]


def test_terms_are_found_without_sorting_by_a_key(monkeypatch):
    """Terms are put in order as arrays: no comparison of theirs runs in Python."""
    import builtins

    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"lang": ["de", "en", "de"], "source": ["a", "b", "b"], "text": ["Zwei eins zwei", "one two", "éins zwei"]})
    monkeypatch.setattr(D, "sorted", lambda x, key=None, **more: pytest.fail("a key") if key else builtins.sorted(x, **more), raising=False)
    tries = {}
    D._add(tries, rows)
    got = {k: [(t.decode(), leaf.documents, leaf.sources) for t, leaf in trie.walk()] for k, trie in tries.items()}
    assert got == {"de": [("eins", 1, {"a": 1}), ("zwei", 2, {"a": 2, "b": 1}), ("éins", 1, {"b": 1})], "en": [("one", 1, {"b": 1}), ("two", 1, {"b": 1})]}
