import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gradeloom.llm import common, langid, quality, secrets
from tests.llm import test_cpsjoin, test_langid, test_packing, test_quality, test_secrets
from tests.llm.conftest import DOCS, prose


def test_stages(spark, clashing, odd_rows):
    docs = clashing
    seen = [len(odd_rows)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        seen.append(len(rows))
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_an_empty_corpus(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


# --- the whole pipeline against plain loops ------------------------------------------------


def corpus():
    rng = random.Random(11)
    words = {"en": "abcdefgh", "de": "defghijk", "fr": "hijklmno"}
    rows = []
    for i in range(240):
        lang = rng.choice(list(words))
        text = prose(rng, rng.randint(40, 160), words[lang])
        if i % 9 == 0:
            text += " password = 'aB3dEfGh1jKlMn' " + "0123456789abcdef" * (i % 2)
        if i % 13 == 0:
            text = text.replace(" ", "## ")
        rows.append((i, text, None if i % 17 == 0 else lang, f"s{i % 3}", len(text)))
    for i in range(0, 60, 4):  # near and exact copies
        t = rows[i][1].split()
        if i % 8:
            t[len(t) // 2] = "changed"
        rows.append((1000 + i, " ".join(t) if i % 8 else rows[i][1], rows[i][2], "s1", 0))
    long = prose(rng, 9000, words["de"])
    mixed = prose(rng, 60, "abc") + " " + prose(rng, 60, "mno")
    rows += [(2000, long, "de", "s0", len(long)), (2001, mixed, None, "s2", 0), (2002, None, "en", "s0", 0), (2003, "", None, None, 0), (2004, " ".join(str(rng.randrange(1000, 99999)) for _ in range(90)), "en", "s1", 0)]
    return rows


def brute_quality(rows):
    """Sketches, percentiles and mixed fences in plain loops."""
    def values(r):
        n, chars, symbols, dup, rep = test_quality.brute(r[1])
        bad = n < 50 or rep * 100 > n * 50
        n = max(n, 1)
        return bad, {"symbols": symbols * 1000 // n, "word_length": chars * 100 // n, "dup_lines": dup * 1000 // n, "repeats": rep * 1000 // n}

    def fence(group):
        out = {}
        for m in quality.MEASURES:
            xs = sorted(v[m.name] >> (s := max(v[m.name].bit_length() - quality.PRECISION, 0)) << s for v in group)
            inner, outer, low = (next(x for k, x in enumerate(xs, 1) if k * 100 >= len(xs) * p) for p in (m.inner, m.outer, 100 - m.outer))
            reach = m.fence * max(outer - inner, m.resolution)
            out[m.name] = (max(low - reach, 0), outer + reach)
        return out

    measured = [(r, *values(r)) for r in rows]
    good = [(r, v) for r, bad, v in measured if not bad]
    w = quality.WEIGHT
    mix = lambda n, own, coarse: {m: tuple((n * a + w * b) // (n + w) for a, b in zip(own[m], coarse[m], strict=True)) for m in own}
    whole = fence([v for _, v in good])
    kept = []
    for r, v in good:
        lang = [x for s, x in good if s[2] == r[2]]
        source = [x for s, x in good if s[2] == r[2] and s[3] == r[3]]
        f = mix(len(source), fence(source), mix(len(lang), fence(lang), whole))
        if all(v[m.name] <= f[m.name][1] and (not m.low_side or v[m.name] >= f[m.name][0]) for m in quality.MEASURES):
            kept.append(r)
    return kept


def brute_language(spark, rows):
    samples = langid.labelled_sample(spark.createDataFrame(rows, DOCS).select("doc_id", "text", "lang"))
    folded = {x: langid.folded(s) for x, s in samples.items()}
    kept = []
    for r in rows:
        if not any(map(str.isalpha, r[1])):
            continue
        bits = sorted(test_langid.brute_phrases(langid.folded(r[1]), s) * np.log2(max(len(s), 2)) for s in folded.values())
        if 1 - bits[0] / bits[1] >= 0.01:
            kept.append(r)
    return kept


def brute_copies(rows):
    classes = {i: c for i, c, _, _ in test_cpsjoin.brute(rows)}
    return [r for r in rows if classes[r[0]] == r[0]]


def brute_redacted(rows):
    out = []
    for r in rows:
        spans, at, text = [], 0, ""
        for s in filter(None, test_secrets.brute(r[1])[-1].split(",")):
            kind, a, b = s.split(":")
            spans.append((int(a), [x.kind for x in secrets.RULES].index(kind), int(b), kind))
        for a, _, b, kind in sorted(spans):
            if a >= at:
                text += r[1][at:a] + f"[{kind}]"
            at = max(at, b)
        out.append((*r[:1], text + r[1][at:], *r[2:]))
    return out


def test_against_plain_loops(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    step = brute_quality(rows)
    assert 150 < len(step) < len(rows)
    known = brute_language(spark, step)
    assert 150 < len(known) < len(step)
    single = brute_copies(known)
    assert len(single) < len(known) - 8
    clean = brute_redacted(single)
    assert sum(a[1] != b[1] for a, b in zip(single, clean, strict=True)) > 8
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (_, stage), want in zip(corpus_pipeline.STAGES, (step, known, single, clean), strict=False):
        docs = common.saved(stage(spark, docs, str(tmp_path)), "stage", held=False)
        got = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        assert Counter(got) == Counter(r[:4] for r in want)
    test_packing.check(corpus_pipeline.run(spark, str(tmp_path)).collect(), [r[:2] for r in clean])


def test_a_run_frees_its_own_tables_only(spark, tmp_path, monkeypatch):
    """What was made before a run, or by another run, can be read after it."""
    spark.createDataFrame(corpus()[:60], DOCS).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("quality_rules", "secret_scans")])
    judged = quality.op1_quality_rules(spark, str(tmp_path))
    first, second = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    assert first.count() == second.count() > 30
    assert judged.count() == 60


def test_scopes_of_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    def stored(name):
        return common.saved(spark.range(5), name)

    with ThreadPoolExecutor(1) as pool:
        with common.scope(spark):
            other = pool.submit(stored, "other").result()
        assert spark.read.schema(other.schema).parquet(common._stored[id(other)][1]).count() == 5


def test_scopes(spark):
    at = {}

    def stored(name, **how):
        df = common.saved(spark.range(5), name, **how)
        at[name] = common._stored[id(df)][1]
        return df

    def there(name):
        return spark.read.schema("id long").parquet(at[name]).count()

    stored("before")
    with common.scope(spark):
        stored("own")
        kept = stored("kept", held=False)
        with common.scope(spark):
            stored("inner")
        assert there("own") == 5
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            there("inner")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        there("own")
    assert there("before") == there("kept") == 5
    common.forget(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        there("kept")
    with pytest.raises(ValueError, match="odd"), common.scope(spark):
        stored("lost")
        raise ValueError("odd")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        there("lost")
