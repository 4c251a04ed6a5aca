import random

import numpy as np
import pytest

from gradeloom.llm import components as C
from gradeloom.llm import cpsjoin as J
from tests.llm.conftest import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    label, links, texts = list(range(n)), [0] * n, [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 1000 * len(a & b) >= 1000 * threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                if rows[i][1] != rows[j][1]:
                    texts[i].add(rows[j][1])
                    texts[j].add(rows[i][1])
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        out.append((r[0], min(ids, default=None), links[i], len(texts[i])))
    return sorted(out, key=repr)


def near(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = []
    for _ in range(12):
        base = " ".join(word() for _ in range(rng.randint(60, 200)))
        for k in range(rng.randint(1, 6)):
            rows.append((len(rows), near(rng, base, k * 2), "en", "s", 0))
    hub = " ".join(word() for _ in range(150))
    rows += [(1000 + i, near(rng, hub, 1 + i % 3), "en", "s", 0) for i in range(60)]
    rows += [(2000 + i, hub, "en", "s", 0) for i in range(20)]
    shared = " ".join(word() for _ in range(55))
    rows += [(3000 + i, shared + " " + " ".join(word() for _ in range(150)), "en", "s", 0) for i in range(30)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # every path: levels over the cluster, blocks of buckets, blocks of components
        for k, v in {"LEAF": 4, "LOCAL": 16, "LEVELS": 2, "BLOCK_TEXTS": 16}.items():
            monkeypatch.setattr(J, k, v)
    rows = corpus()
    got = J.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_texts_on_deep_paths_get_further_runs(spark, monkeypatch):
    """Texts that share 60 % of their tokens don't fall apart within three levels."""
    asked, run_edges = [], J.run_edges
    monkeypatch.setattr(J, "run_edges", lambda sigs, join, done, runs: asked.append((done, runs)) or run_edges(sigs, join, done, runs))
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 1 << 32, (1500, J.TOKENS), dtype=np.uint32)
    sigs[rng.random(sigs.shape) < 0.6] = 7
    rows = [(b"%d" % i, x.tobytes()) for i, x in enumerate(sigs)]
    J.candidate_edges(spark.createDataFrame(rows, "text_id binary, sig binary").cache(), J.Join())
    assert asked[0] == (0, 7) and asked[1][0] == 7 and asked[-1][1] >= J.Join().runs_at(4) > 7


def test_runs_follow_the_levels():
    j = J.Join()
    assert j.runs == j.runs_at(3) == 7
    first = j._missed(3) ** j.runs
    for levels in range(4, J.LEVELS + J.DEPTH + 1):
        assert first + j._missed(levels) ** j.runs_at(levels) <= 1 - j.recall


def test_odd_rows(spark, odd_docs, odd_rows, clashing, no_docs):
    got = J.jaccard_join(odd_docs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(odd_rows)
    assert same(J.jaccard_join(clashing), got)
    assert J.jaccard_join(no_docs).count() == 0


def test_one_per_class(spark, clashing, odd_rows, no_docs):
    kept = J.one_per_class(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([1, 4, 5, 6, None, 8, 9, 11, 12, 13], key=repr)
    assert J.one_per_class(no_docs).count() == 0


def test_linked_is_exact():
    rng = np.random.default_rng(1)
    pool = np.arange(1, 400, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, rng.integers(1, 300), replace=False)) for _ in range(25)]
    want = [[i != j and 1000 * len(set(a) & set(b)) >= 500 * len(set(a) | set(b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert J.linked(sets, 0.5).tolist() == want
    for k in (1, 2, 5):
        assert J.linked(sets[:k], 0.5).tolist() == [row[:k] for row in want[:k]]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    got = {r["id"]: r["root"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in label}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_on_deep_paths(spark, monkeypatch):
    """Pairs just above the threshold, among texts that share so much that they take many levels to
    fall apart: the links that are there are found."""
    for k, v in {"LEAF": 4, "LOCAL": 64}.items():
        monkeypatch.setattr(J, k, v)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = " ".join(word() for _ in range(100))
    rows = []
    for i in range(600):
        own = [word() for _ in range(120)]
        copy = list(own)
        for p in range(12, 12 + 25 * rng.choice((3, 4)), 25):
            copy[p] = word() + "x"
        rows += [(2 * i, shared + " " + " ".join(own)), (2 * i + 1, shared + " " + " ".join(copy))]
    pairs = []
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingles(a[1]), shingles(b[1])
        s = len(x & y) / len(x | y)
        if s >= 0.8:
            pairs.append(a[0])
            assert s < 0.9
    assert len(pairs) == 600
    got = {r["doc_id"]: r for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[i]["class_id"] == got[i + 1]["class_id"] == i and got[i]["n_text_links"] == 1 for i in pairs)
    assert found >= 0.99 * len(pairs)


def test_whole_documents_against_all_pairs(spark):
    """Every pair of the small table at 0.8 or more is linked, and no other."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_the_sieve_lets_all_members_pass(spark, monkeypatch):
    monkeypatch.setattr(J, "FILTER_BITS", 1 << 10)
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("text_id"), "id")
    some = J.sieved(rows, rows.where("id % 50 = 0").select("text_id"))
    ids = {r["id"] for r in some.collect()}
    assert {i for i in range(0, 5000, 50)} <= ids and len(ids) < 1200 and some.columns == rows.columns


def test_stars_keep_components():
    rng = random.Random(11)
    edges = [(b"%03d" % rng.randrange(300), b"%03d" % rng.randrange(300)) for _ in range(220)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted(J.stars(edges)) == sorted((r, x) for x, r in label.items() if r != x)
    assert J.stars([]) == []


def test_stars_are_told_without_another_round(spark, monkeypatch):
    stored, saved = [], C.saved
    monkeypatch.setattr(C, "saved", lambda df, name: stored.append(name) or saved(df, name))
    star = [(1, i) for i in range(2, 40)] + [(50, 51)]
    got = {r["id"]: r["root"] for r in C.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {1: 1, 50: 50} | {b: a for a, b in star}
    assert stored == ["edges", "least"]


def test_texts_without_a_verdict_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(17)
    words = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(400)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(words)] + [(1000 + i, words[i]) for i in range(9)] + [(4, words[4])] * 2 + [(None, words[5]), (None, "alone here"), (7, None)]
    seen, sifted = [], J.sifted
    monkeypatch.setattr(J, "sifted", lambda *a: seen.append(sifted(*a)) or seen[-1])
    kept = J.one_per_class(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(i, t) for i, t in enumerate(words)] + [(None, "alone here"), (7, None)]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)
    assert 10 <= seen[-1].where("_maybe").count() < 30 and seen[-1].count() == len(rows)


def test_signatures_without_a_partner_are_not_shuffled(spark, monkeypatch):
    """Only paths and signatures that may meet others go on, the latter by half; no pair is lost."""
    rng = np.random.default_rng(7)
    sigs = rng.integers(0, 1 << 32, (3000, J.TOKENS), dtype=np.uint32)
    sigs[1000:1010] = sigs[:10]
    rows = spark.createDataFrame([(b"%04d" % i, x.tobytes()) for i, x in enumerate(sigs)], "text_id binary, sig binary").cache()
    low = {bytes(r["text_id"]): np.frombuffer(r["low"], dtype=np.uint16) for r in rows.select("text_id", J.halved("sig").alias("low")).collect()}
    assert all((low[b"%04d" % i] == (x & 0xFFFF)).all() for i, x in enumerate(sigs))
    passed, sieved = {}, J.sieved
    monkeypatch.setattr(J, "sieved", lambda rows, ids, key="text_id": passed.setdefault(tuple(rows.columns), sieved(rows, ids, key)))
    edges = J.candidate_edges(rows, J.Join()).distinct().collect()
    assert {(bytes(r["a"]), bytes(r["b"])) for r in edges} == {(b"%04d" % i, b"%04d" % (1000 + i)) for i in range(10)}
    assert passed["text_id", "sig"].count() < 60 and passed["path", "text_id"].count() < 600
