import zlib
from collections import Counter, defaultdict

from gradeloom.llm import shards as S


def check(rows, docs, shards):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    size = Counter()
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return [size[i] for i in range(shards)]


def test_balance_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = S.kd_shards(docs).collect()
    size = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 8)
    largest = max(r["size"] for r in rows)
    assert max(size) - min(size) <= largest


def test_copies_of_one_text_are_divided(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    rows = [(i, "same text", "en", "s", 9) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    size = check(S.kd_shards(df).collect(), [r[:2] for r in rows], 8)
    assert max(size) - min(size) <= 2 * 10


def brute_tree(rows, shards, whole):
    """Leaves by sorting: rows are (tie, d0..d3, size); exact to the last key."""
    out = {}

    def split(part, first, n):
        dims = [(max(r[1 + i] for r in part) - min(r[1 + i] for r in part)) / max(whole[i], 1) for i in range(4)]
        if n == 1 or (max(dims) == 0 and len({r[0] for r in part}) == 1):
            out.update({r: first for r in part})
            return
        d = dims.index(max(dims))
        key = lambda r: (r[1 + d], r[0])
        total = sum(r[5] for r in part)
        goal, at = total * (n // 2 / n), 0
        sizes = Counter()
        for r in part:
            sizes[key(r)] += r[5]
        for k in sorted(sizes):
            if at + sizes[k] > goal:
                behind = abs(at + sizes[k] - goal) < abs(at - goal)
                break
            at += sizes[k]
        left = [r for r in part if key(r) < k or (behind and key(r) == k)]
        bytes_ = sum(r[5] for r in left)
        half = min(max(int(bytes_ / total * n + 0.5), 1), n - 1)
        kept = set(left)
        for some, a, b in ((left, first, half), ([r for r in part if r not in kept], first + half, n - half)):
            if some:
                split(some, a, b)

    if rows:
        split(rows, 0, shards)
    return out


def test_against_a_sorted_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for shards in (1, 3, 8, 37):
        rows = S.saved(S.points(docs), "points")
        cols = ("tie", "d0", "d1", "d2", "d3", "size")
        mine = [tuple(r) for r in rows.select(*cols).collect()]
        assert len(set(mine)) == len(mine)
        whole = [max(r[1 + i] for r in mine) - min(r[1 + i] for r in mine) for i in range(4)]
        assert sum(w > 0 for w in whole) == 4  # language, source, length and number all spread
        want = brute_tree(mine, shards, whole)
        got = {tuple(r)[:6]: r["shard"] for r in S.tree(rows, shards, tolerance=0.0).select(*cols, "shard").collect()}
        assert got == want and len(set(got.values())) == shards


def test_coordinates_keep_the_order(spark):
    rows = [(5, "a", "en", "src10", 7), (6, "b", "de", "src2", 9), (7, "c", None, "src", None), (None, "d", "fr", None, 1 << 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    p = {r["text_crc32"]: r for r in S.points(df).collect()}
    a, b, c, d = (p[zlib.crc32(x.encode())] for x in "abcd")
    assert c["d0"] == 0 < b["d0"] < a["d0"] < d["d0"] and d["d1"] == 0 == c["d1"] < a["d1"] < b["d1"]
    assert c["d2"] == 0 < a["d2"] < b["d2"] < d["d2"] == S.TOP and d["d3"] == 0 == a["d3"] < b["d3"] < c["d3"] == S.TOP


def test_one_text_larger_than_the_shards(spark):
    rows = [(i, "x" * (50_000 if i == 20 else 5), "en", "s", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = S.kd_shards(df).collect()
    check(got, [r[:2] for r in rows], 8)
    alone = next(r["shard"] for r in got if r["doc_id"] == 20)
    assert sum(r["shard"] == alone for r in got) == 1


def test_odd_rows(spark, odd_docs, odd_rows, clashing, no_docs):
    check(S.kd_shards(odd_docs).collect(), [r[:2] for r in odd_rows], 8)
    assert S.kd_shards(no_docs).count() == 0
    check(S.kd_shards(clashing.selectExpr("*", "1 as row", "2 as tie", "3 as d0", "4 as bytes")).collect(), [r[:2] for r in odd_rows], 8)


def test_leaves_by_target(spark):
    rows = [(i, "x" * (i % 50), "en", f"s{i % 5}", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    total = sum(len(r[1]) + 1 for r in rows)
    got = S.kd_shards(df, shards=None, target_bytes=1500).collect()
    n = -(-total // 1500)
    size = check(got, [r[:2] for r in rows], n)
    assert max(size) <= 1500 + 60
