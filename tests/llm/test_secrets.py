import hashlib
import re

import pytest

from gradeloom.llm import secrets as S
from gradeloom.llm import trigrams as T
from tests.llm.conftest import same


def brute(text):
    t, found = text or "", []
    for no, r in enumerate(S.RULES):
        for m in re.finditer(r.pattern, t, re.A):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), no, m.end(), r.kind))
    found.sort()
    base = [f for f in found if S.RULES[f[1]].base]
    join = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, b, k in xs)
    n = [sum(f[1] == i for f in found) for i in range(3)]
    return (*n, hashlib.sha256(join(base).encode()).hexdigest(), join(found))


def test_against_brute_force(spark, odd_docs, odd_rows):
    got = sorted(map(repr, map(tuple, S.secret_spans(odd_docs).collect())))
    assert got == sorted(repr((r[0], *brute(r[1]))) for r in odd_rows)
    assert any("github" in g for g in got) and any("access" in g for g in got)


@pytest.mark.parametrize("rule", S.RULES, ids=lambda r: r.kind)
def test_every_match_meets_its_query(rule):
    texts = ['password="abcdefghijklmn"', "API_KEY: AbCd.efgh-ijkl=", "apikey = 'x1234567890yz'", "AKIA" + "Z9" * 10, "0" * 20, "gho_" + "q" * 40, "xoxb-1234567890", "AIza" + "k" * 35, "eyJabcdefgh1.eyJabcdefgh2", "-----BEGIN RSA PRIVATE KEY-----", "Passwd:abcdefghijklm"]
    for t in texts:
        if re.search(rule.pattern, t):
            low = t.lower()
            assert all(any(all(x in low for x in alt) for alt in clause) for clause in T.query(rule.pattern))


def test_derived_queries():
    assert T.query(r"[0-9a-f]{16,}") == []
    assert T.query(r"abcd") == [frozenset([frozenset(["abc", "bcd"])])]
    assert T.query(r"(?:abc|xyzw)+q?") and T.query(r"(abc)*") == [] and T.query("a|bcd") == []


def test_redaction(spark, clashing, odd_rows):
    got = {r["doc_id"]: r for r in S.redact_secrets(clashing).collect()}
    assert "aB3dEfGh1jKlMn" not in got[11]["text"] and "[assign]" in got[11]["text"] and "[access]" in got[11]["text"]
    assert got[4]["text"] is None and got[5]["text"] == ""
    assert got[11]["n_chars"] == len(got[11]["text"])
    assert S.redact_secrets(clashing).columns == clashing.columns
    assert S.redact_secrets(clashing).count() == len(odd_rows)


def test_edges(spark, odd_docs, clashing, no_docs):
    assert S.secret_spans(no_docs).count() == 0
    assert same(S.secret_spans(clashing), S.secret_spans(odd_docs))
