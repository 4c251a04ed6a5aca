import gzip
import hashlib
from collections import Counter

import pytest

from gradeloom.llm import warc as W
from tests.llm.conftest import same

PAGES = "page_id long, url string, html string"
BIG = "<p>é" * 60_000
ROWS = [
    (5, "http://a/1", "x" * 150), (3, "http://a/2", "x" * 150), (9, "http://a/3", "x" * 150), (7, "u", "short"), (8, "u", "short"), (1, None, None), (2, "u\r\nv", ""),
    (4, "u", BIG), (6, "u", BIG), (6, "u", BIG), (None, "u", "y" * 200), (10, "u", "y" * 200), (11, "u", "0\r\n\r\n" * 50), (12, "u", "é" * 50), (13, "u", "é" * 50),
]


def brute(rows):
    first = {}
    for p, _, h in rows:
        if h and len(h.encode()) >= 100 and p is not None:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        to = first.get(h) if len(b) >= 100 and p != first.get(h) else None
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to))
    return Counter(out)


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, PAGES)
    got = W.warc_round_trip(df)
    assert Counter(map(tuple, got.collect())) == brute(ROWS)
    from pyspark.sql import functions as F

    more = df.select("*", *[F.lit("x").alias(c) for c in ("digest", "refers_to", "path", "content", "n", "kind", "segment", "block")])
    assert same(W.warc_round_trip(more), got)
    assert W.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_small_segments_and_archives(spark):
    df = spark.createDataFrame(ROWS, PAGES)
    files = W.archives(W.planned(df), segment_bytes=1000, archive_bytes=5000)
    got = W.read_archives(files).collect()
    want = Counter((str(p) if p is not None else None, n, d, k, str(t) if t is not None else None) for (p, n, d, k, t), c in brute(ROWS).items() for _ in range(c))
    assert Counter(map(tuple, got)) == want


def test_segments_must_be_complete(spark):
    segs = [("o", 1, 0, b"HTTP/1.1 200 OK\r\n\r\nab"), ("o", 2, 0, b"cd"), ("o", 3, 25, b"ef")]
    rows = [("1", hashlib.sha256(b"abcdef").hexdigest(), o, None, n, t, b) for o, n, t, b in segs]
    schema = "page_id string, digest string, id string, place string, segment int, total long, block binary"
    assert W.reassembled(spark.createDataFrame(rows[::-1], schema)).collect()[0][3:] == (6, True)
    missing = W.reassembled(spark.createDataFrame([rows[0], rows[2]], schema)).head()
    assert missing["complete"] is False and missing["n"] is None


def test_revisits_refer_to_records_that_are_there(spark):
    df = spark.createDataFrame(ROWS, PAGES)
    files = W.archives(W.planned(df), segment_bytes=1000, archive_bytes=5000)
    found = [h for r in files.collect() for h, _ in W.records(bytes(r["content"]))]
    ids = {h["warc-record-id"] for h in found if h["warc-type"] == "response"}
    to = [h["warc-refers-to"] for h in found if h["warc-type"] == "revisit"]
    assert to and set(to) <= ids and any(h["warc-type"] == "continuation" for h in found)
    only = spark.createDataFrame([("x", W.record({"WARC-Type": "revisit", "WARC-Record-ID": "<a>", "X-Page-ID": "1", "WARC-Payload-Digest": "sha256:0", "WARC-Refers-To": "<b>"}, b""))], "path string, content binary")
    with pytest.raises(Exception, match="no response <b>"):
        W.read_archives(only).collect()


def test_the_small_tables_reassemble(spark):
    """The oracle row goes through segments: some pages are longer than one."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert pages.where(f"octet_length(html) > {W.SEGMENT_BYTES}").count() > 0


def test_framing():
    for n in (0, 1, 10, 8192, 20_001):
        p = bytes(i % 251 for i in range(n))
        assert W.unchunked(W.chunked(p, 1000)) == p
    assert W.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n", b""):
        with pytest.raises(ValueError):
            W.unchunked(bad)
    with pytest.raises(ValueError):
        list(W.records(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab")))
