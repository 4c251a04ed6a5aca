import re
from collections import Counter

from gradeloom.llm import quality as Q
from gradeloom.llm.common import saved
from tests.llm.conftest import same


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark, odd_docs, odd_rows):
    got = Q.quality(odd_docs)
    by = Counter((r["doc_id"], *[r[c] for c in Q.COUNTS]) for r in got.collect())
    assert by == Counter((r[0], *brute(r[1])) for r in odd_rows)


def test_overlapping_repeats(spark):
    text = "a b a b a b c " + "x y z q x y z"
    df = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    assert Q.quality(df).head()["n_repeat_words"] == brute(text)[4]


def test_sketch_is_merged_and_fences_reject_outliers(spark):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", f"s{i % 3}") for i in range(60)]
    junk = [(900 + i, " ".join(f"w{i}y{j}***" for j in range(60)), "en", "s0") for i in range(5)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    for weight in (0, 50, 10**6):  # own fences, mixed ones, in effect the corpus's
        kept = {r["doc_id"]: r["kept"] for r in Q.quality(df, weight=weight).collect()}
        assert all(kept[i] for i in range(60)) and not any(kept[900 + i] for i in range(5))


def test_a_source_with_many_documents_has_its_own_fences(spark):
    def text(i, n):
        return " ".join(f"w{i}x{j}" + "#" * n for j in range(60))

    # symbols per 1,000 words: none in one source, 1,000 in the other
    rows = [(i, text(i, 0), "en", "plain") for i in range(300)] + [(1000 + i, text(i, 1), "en", "marked") for i in range(300)]
    rows += [(5000, text(1, 1), "en", "plain"), (5001, text(2, 1), "en", "marked"), (5002, text(3, 1), "en", "new"), (5003, text(4, 0), "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in Q.quality(df).collect()}
    assert not kept[5000] and kept[5001] and kept[5002] and kept[5003]
    assert all(v for k, v in kept.items() if k != 5000)
    fences = {(r["f_lang"], r["f_source"]): r["f_symbols_hi"] for r in Q.source_fences(Q.text_measures(df), Q.WEIGHT).collect()}
    language = 4 * 992  # as the corpus; quartiles 0 and 992, the bucket of 1,000
    assert fences["en", "plain"] == (301 * 3 * 20 + 50 * language) // 351 < 1000 <= fences["en", "marked"]


def test_fences_meet_the_sql_on_larger_groups(spark, tmp_path):
    """Per-source fences decide here: groups of several hundred documents."""
    import duckdb

    rng = __import__("random").Random(4)
    rows = []
    for i in range(2400):
        source = rng.choice(["a", "b", None])
        marks = rng.choice([0, 0, 1, 2]) if source == "a" else rng.choice([0, 0, 0, 0, 0, 1])
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" + "#" * marks * (rng.random() < 0.7) for _ in range(rng.randint(40, 70))), rng.choice(["en", "de"]), source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = Counter(con.execute(Q.ORACLE).fetchall())
    got = Q.quality(df)
    assert Counter(map(tuple, got.collect())) == want
    kept = {(s, k): n for s, k, n in con.execute(f"SELECT source, kept, count(*) FROM ({Q.ORACLE}) JOIN documents USING (doc_id) WHERE NOT base_failed GROUP BY ALL").fetchall()}
    assert kept["b", False] > 50 and kept["a", True] > 300


def test_bucket_keeps_leading_bits(spark):
    from pyspark.sql import functions as F

    got = spark.range(0, 5000).select("id", Q.sketch_bucket(F.col("id")).alias("b")).collect()
    for r in got:
        shift = max(r["id"].bit_length() - Q.PRECISION, 0)
        assert r["b"] == r["id"] >> shift << shift


def test_empty_and_clashing(spark, odd_docs, clashing, no_docs):
    assert Q.quality(no_docs).count() == 0
    assert same(Q.quality(clashing), Q.quality(odd_docs))
    assert Q.filter_quality(clashing).columns == clashing.columns
    kept = {r["doc_id"] for r in Q.quality(odd_docs).collect() if r["kept"]}
    assert {r["doc_id"] for r in Q.filter_quality(odd_docs).collect()} == kept
    assert Q.filter_quality(no_docs).count() == 0


def test_fences_come_from_the_sketches(spark):
    """On the driver's documents the corpus decides, not a constant: fences differ between sources and lie
    beyond a multiple of the measured distances, for all but symbols, which nearly all documents lack."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured = saved(Q.text_measures(docs).drop("text"), "measures").where(~Q.base_failed())
    fine = Q.sketches(measured, ["lang", "source"])
    own, by_lang = Q.fences(fine, ["lang", "source"]).collect(), Q.fences(Q.merged(fine, ["lang"]), ["lang"]).collect()
    assert len(own) == 80 and len(by_lang) == 4
    # quantiles of 0 and the least distance between them would give fence * resolution
    above = lambda rows, m: sum(r[f"{m.name}_hi"] > m.fence * m.resolution for r in rows)
    _, length, lines, repeats = Q.MEASURES
    for m in (length, repeats):
        assert len({r[f"{m.name}_hi"] for r in own}) > 10 and above(own, m) > len(own) / 2
    assert all(above(by_lang, m) == 4 for m in (length, lines, repeats))  # few documents repeat lines; sources' fences are drawn to these


def test_each_measure_rejects(spark):
    rng = __import__("random").Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    plain = [" ".join(word(rng.randint(3, 7)) for _ in range(rng.randint(80, 120))) for _ in range(300)]
    odd = {
        1000: " ".join(word(5) + "#" * (i % 5 == 0) for i in range(100)),  # symbols
        1001: " ".join(word(25) for _ in range(100)),  # long words
        1002: " ".join(word(1) for _ in range(100)),  # short words
        1003: "\n".join([word(9)] * 40 + [" ".join(word(5) for _ in range(6)) for _ in range(25)]),  # lines
        1004: " ".join([word(5) for _ in range(70)] + ["one two three"] * 20),  # repeats
    }
    rows = [(i, t, "en", "s") for i, t in enumerate(plain)] + [(i, t, "en", "s") for i, t in odd.items()]
    kept = {r["doc_id"]: r["kept"] for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in odd)
