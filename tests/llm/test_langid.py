import random

import numpy as np

from gradeloom.llm import langid as L
from tests.llm.conftest import prose, same


def brute_phrases(text, sample):
    """Greedy longest matches in the sample over the whole folded text; a letter that the
    sample doesn't have is a phrase of its own."""
    total = i = 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample and text[i : i + n] in sample:
            n += 1
        total += 1
        i += n
    return total


def test_lock_step_parse_is_the_greedy_parse(monkeypatch):
    rng = random.Random(3)
    samples = {"a": prose(rng, 300, "abcde"), "b": prose(rng, 300, "defgh")}
    model = L.train(samples)
    inside = L.folded(samples["a"])
    texts = [prose(rng, n, "abcdefghxyz") + "! 12" for n in (1, 5, 60, 700)] + ["", samples["a"], inside[100:900] + inside[40:700], "x" * 3000, "a" * 2500, "é漢" * 900]
    want = [[brute_phrases(L.folded(t), L.folded(samples[x])) for x in "ab"] for t in texts]
    for block in (1024, 256, 7, 1):  # phrases run over the borders of blocks
        monkeypatch.setattr(L, "BLOCK", block)
        assert L.phrases([L.coded(t, model) for t in texts], model).tolist() == want


def test_predictions_against_brute_force(monkeypatch):
    """Language and score of whole texts, by a search of every phrase in the samples."""
    rng = random.Random(9)
    samples = {"a": prose(rng, 900, "abcdefg"), "b": prose(rng, 800, "cdefghi"), "c": prose(rng, 850, "efghijk")}
    model = L.train(samples)
    texts = [prose(rng, rng.choice([1, 3, 30, 400, 2500]), "".join(rng.sample("abcdefghijklm", 7))) for _ in range(30)] + [None, "12 !", ""]
    monkeypatch.setattr(L, "BATCH_CHARS", 9000)
    langs, scores = L.predict(texts, model)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        if not t or not any(map(str.isalpha, t)):
            assert (lang, score) == ("und", 0)
            continue
        bits = {x: brute_phrases(L.folded(t), L.folded(s)) * np.log2(len(s)) for x, s in samples.items()}
        best = min(sorted(bits), key=bits.get)
        assert lang == best and abs(score - (1 - bits[best] / min(v for x, v in bits.items() if x != best))) < 1e-12


def test_transitions_have_cells_of_their_own():
    rng = random.Random(2)
    wide = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(4000))
    model = L.train({"zh": wide, "en": prose(rng, 500)})
    edges = L.suffix_automaton(wide)
    rows = sum(map(len, edges))
    assert len(model.cells) < 4 * (rows + 6000) + 3 * 3100  # not states times alphabet
    zh = model.langs.index("zh")
    offset = int(model.start[zh]) - len(edges)
    for s in range(0, len(edges), 37):
        for c, to in edges[s].items():
            state, opens = L._step(model, np.array([[s + offset]]), np.array([model.codes[ord(c)]]))
            assert not opens[0, 0] and state[0, 0] == to + offset


def test_automaton_has_just_the_substrings():
    text = "abcbcabb"
    edges = L.suffix_automaton(text)

    def accepts(s):
        at = 0
        for c in s:
            if c not in edges[at]:
                return False
            at = edges[at][c]
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(accepts(s) for s in subs)
    assert not any(accepts(s) for s in ("cc", "aa", "bcbb", "x") if s not in subs)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    got = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_labels_do_not_reach_predictions(spark, odd_docs):
    from pyspark.sql import functions as F

    model = L.train(L.labelled_sample(odd_docs.select("doc_id", "text", "lang")))
    a = L.identify(odd_docs.select("doc_id", "text"), model)
    b = L.identify(odd_docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit(1).alias("source")), model).drop("lang", "source")
    assert same(a, b)


def test_edges(spark, odd_docs, clashing, no_docs):
    got = {r["doc_id"]: r for r in L.language_id(odd_docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6))
    assert got[8]["lang_pred"] in ("en", "fr")
    assert L.language_id(no_docs).count() == 0
    assert same(L.language_id(clashing), L.language_id(odd_docs))
    unlabelled = odd_docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source")
    assert {r["lang_pred"] for r in L.language_id(unlabelled).collect()} == {"und"}
    assert L.filter_language(clashing).columns == clashing.columns
    assert np.isfinite([r["score"] for r in got.values()]).all()
