"""Whitening and nearest neighbours against plain NumPy."""

import math

import numpy as np
import pytest

from gradeloom.llm import vptree as V
from gradeloom.llm import whitening as W

ROWS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, non-finite entries, zeros, empty and short vectors, copies, repeated rows and ids."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 6)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    rows += [(100 + i, base[0].tolist(), 1) for i in range(40)]  # copies of one vector
    rows += [(3, base[3].tolist(), 9), (None, base[5].tolist(), 1), (150, None, 1), (151, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (152, [float("nan")] * 6, 1), (153, [float("inf")] * 6, 1)]
    rows += [(160, [0.0] * 6, 1), (180, [-0.0] * 6, 1), (161, [], 1), (162, [2.0, 1.0], 1), (163, [2.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (60, [5.0, 5.0, 0.0, 0.0, 0.0, 0.0], 1)]
    return rows


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_whitening_against_numpy(spark, odd, tmp_path):
    spark.createDataFrame(odd, ROWS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.op11_embedding_whitening(spark, str(tmp_path)).collect()
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (6 - len(v))) for i, v, _ in odd if sound(v)]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    cov = z.T @ z / n
    e, b = np.linalg.eigh(cov)
    e, b = e[::-1], b[:, ::-1]
    want = {}
    for i, x in rows:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        w = (np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ b[:, :4]) / np.sqrt(e[:4])
        for j in range(4):
            want.setdefault((i, j + 1, deviation), []).append(abs(w[j]))
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["component"], r["deviation"]), []).append(abs(r["whitened"]))
        assert r["n"] == n and abs(r["explained"] - e[r["component"] - 1] / cov.trace()) < 1e-9 and r["identity_error"] < 1e-9
    assert found.keys() == want.keys()
    assert all(np.allclose(sorted(found[k]), sorted(want[k]), atol=1e-9) for k in want)
    signs = {}  # one sign a component, for all rows
    for r in got:
        x = next(x for i, x in rows if i == r["vec_id"])
        w = (np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ b[:, r["component"] - 1]) / np.sqrt(e[r["component"] - 1])
        if r["vec_id"] != 60 and abs(w) > 1e-6:
            signs.setdefault(r["component"], set()).add(np.sign(w) == np.sign(r["whitened"]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_without_variance(spark):
    def run(rows):
        df = spark.createDataFrame(rows, ROWS)
        return W.whiten(df, W.fit(W.fit_list(df), "x")).select("vec_id", "whitened.*").collect()

    assert run([]) == []
    assert [(r["deviation"], r["whitened"]) for r in run([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])] == [(0, [None, None])] * 2
    line = run([(1, [0.0, 0.0], 0), (2, [1.0, 1.0], 0)])
    assert [len(r["whitened"]) for r in line] == [2, 2] and [r["whitened"][1] for r in line] == [None, None]
    assert sorted(round(r["whitened"][0], 9) for r in line) == [-1.0, 1.0]
    assert [r["whitened"] for r in run([(1, [], 0)])] == [[]]


def test_whitening_is_exact_beyond_longs(spark):
    df = spark.createDataFrame([(1, [2.0**60, 0.0]), (2, [-(2.0**60), 1.0]), (3, [3.0, 4.0])], "vec_id long, embedding array<double>")
    model = W.fit(W.fit_list(df), "x")
    assert model.sums == [(2**63 - 1) - 2**63 + 768, 5 * 256]  # beyond a long, entries are its ends
    assert all(r["whitened"]["deviation"] is None for r in W.whiten(df, model).where("vec_id < 3").collect())


def test_clashing_names_and_other_columns(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0], "a", "b"), (2, [1.5, 0.0], "c", "d")], "vec_id long, embedding array<float>, _grid_of_rows string, x string")
    out = W.whiten(df, W.fit(W.fit_list(df), "x"))
    assert out.columns == [*df.columns, "whitened"] and out.count() == 2


def brute(rows, asked, k=20):
    dim = max((len(v) for _, v, _ in rows if sound(v)), default=0)
    known = {(i, tuple(np.float32(x) for x in [*v, *[0.0] * (dim - len(v))])) for i, v, _ in rows if i is not None and sound(v) and any(v)}
    out = {}
    for q, v in known:
        if asked(q):
            near = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in known if (i, w) != (q, v))
            out.setdefault(q, []).append(near[:k])
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"], r["rank"]))
    return out


def alike(got, want):
    return [i for _, i, _ in got] == [i for _, i in want] and np.allclose([s for s, _, _ in got], [s for s, _ in want]) and [r for *_, r in got] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("shard_rows", [4096, 16])
def test_factor_one_is_brute_force(spark, odd, monkeypatch, shard_rows):
    monkeypatch.setattr(V, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(V, "LEAF_ROWS", 8)
    df = spark.createDataFrame(odd, ROWS)
    from pyspark.sql import functions as F

    got = listed(V.neighbours(df, F.col("vec_id") % 20 == 0, factor=1.0))
    want = brute(odd, lambda i: i % 20 == 0)
    assert got.keys() == want.keys() and 160 not in got and 60 in got
    for q, lists in want.items():
        if len(lists) == 1:
            assert alike(got[q], lists[0])
        else:  # two vectors of one number
            assert sorted((round(s, 6), i) for s, i, _ in got[q]) == sorted((round(s, 6), i) for x in lists for s, i in x)


def test_shards_are_parted_and_queries_blocked(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD_ROWS", 32)
    monkeypatch.setattr(V, "LEVELS", 2)
    monkeypatch.setattr(V, "DEALT_QUERIES", 10)
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), 0) for i, v in enumerate((rng.normal(size=(600, 8)) * rng.gamma(2, size=(600, 1))).astype(np.float32))]
    from pyspark.sql import functions as F

    got = listed(V.neighbours(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0, factor=1.0))
    want = brute(rows, lambda i: i % 20 == 0)
    assert len(got) == 30 and all(alike(got[q], want[q][0]) for q in want)


def test_ties_at_the_end_go_to_smaller_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 2, 12).astype(float).tolist(), 0) for i in range(1, 900)]  # very many equal products
    from pyspark.sql import functions as F

    got = listed(V.neighbours(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0, factor=1.0))
    want = brute(rows, lambda i: i % 20 == 0)
    assert got.keys() == want.keys() and all(alike(got[q], want[q][0]) for q in want)


def test_few_and_no_rows(spark):
    from pyspark.sql import functions as F

    run = lambda rows: listed(V.neighbours(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0))
    assert run([]) == {}
    assert run([(20, [1.0, 0.0], 0)]) == {}
    assert run([(20, [1.0, 0.0], 0), (1, [-1.0, 5.0], 0), (2, [2.0, 0.0], 0)]) == {20: [(-2.0, 2, 1), (1.0, 1, 2)]}


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_of_the_fitted_factor(spark, monkeypatch, clusters):
    monkeypatch.setattr(V, "SHARD_ROWS", 512)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 24))
    if clusters:
        x = 0.4 * x + 3 * rng.normal(size=(clusters, 24))[rng.integers(0, clusters, len(x))]
    rows = [(i, v, 0) for i, v in enumerate(x.astype(np.float32).tolist())]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, ROWS)
    got = listed(V.neighbours(df, F.col("vec_id") % 20 == 0))
    x = x.astype(np.float32).astype(float)
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(len(s)) * 20] = -np.inf
    true = np.argsort(-s, axis=1)[:, :20]
    recall = np.mean([len({i for _, i, _ in got[20 * q]} & set(t.tolist())) / 20 for q, t in enumerate(true)])
    assert recall >= 0.93
    index = V.build(df)
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 4000, 20)], "key long, v array<float>")
    assert 0 < V.fitted_factor(index, queries) < 1


def test_pruning_by_the_triangle_inequality():
    rng = np.random.default_rng(4)
    x = 0.1 * rng.normal(size=(6000, 16)) + 3 * rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)]
    tree = V.Tree(x, [[i] for i in range(len(x))], float(np.sqrt((x * x).sum(axis=1)).max()))
    q = x[::50]
    true = np.sort(q @ x.T, axis=1)[:, ::-1][:, :21]
    whole = tree.search(q, np.full(len(q), -np.inf), np.zeros(len(q)), 21, 1.0)
    assert np.allclose(whole.score, true) and whole.compared < 0.6 * len(q) * len(x)
    less = tree.search(q, np.full(len(q), -np.inf), np.zeros(len(q)), 21, 0.5)
    assert less.compared < whole.compared and (less.score <= true + 1e-9).all()
