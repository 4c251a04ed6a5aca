"""WARC archives: writing with revisits and segments, and reassembly.

Archives are rows (path, content), the shape of Spark's binaryFile source, so they live
in any store that Spark reads. Records are gzip members, known by page and payload:
``<urn:page:7:digest>``; rows equal in both give equal records with equal identifiers.
A revisit refers to its response's identifier, and is resolved by it. A long record is
cut into segments; on reading, continuation records are grouped by their origin's
identifier, ordered by segment number and checked against the total length before the
chunked transfer framing is decoded.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
ARCHIVE_BYTES = 4 * 1024 * 1024

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for p in range(0, len(payload), size) if (c := payload[p : p + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decodes chunked framing; extensions and trailers are skipped. ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk without a size")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no end of the HTTP header")
    names = {line.partition(b":")[0].strip().lower(): line.partition(b":")[2].strip().lower() for line in head.split(b"\r\n")[1:]}
    return unchunked(body) if names.get(b"transfer-encoding") == b"chunked" else body


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record of an archive of gzip members."""
    while content:
        d = zlib.decompressobj(31)
        raw = d.decompress(content) + d.flush()
        if not d.eof:
            raise ValueError("the archive ends within a record")
        content = d.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        if len(rest) < n:
            raise ValueError("a block is shorter than its Content-Length")
        yield headers, rest[:n]


def record_id(page_id: str, digest: str) -> str:
    return f"<urn:page:{page_id}:{digest}>"


def page_records(name: str, page_id: str, url: str, payload: bytes | None, digest: str, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page: a response, in segments if long, or a revisit.

    name is unique in the archives: it keeps the segments of equal records apart. refers_to
    is the page whose response a revisit repeats.
    """
    rid = record_id(page_id, digest)
    common = {"WARC-Record-ID": rid, "WARC-Date": "2024-01-01T00:00:00Z", "X-Page-ID": page_id, "X-Place": name, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is not None:
        yield record({"WARC-Type": "revisit", **common, "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest)}, HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        yield record({"WARC-Type": "response", **common}, block)
        return
    for no, at in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[at : at + segment_bytes]
        last = {"WARC-Segment-Total-Length": str(len(block))} if at + segment_bytes >= len(block) else {}
        if no == 1:
            yield record({"WARC-Type": "response", **common, "WARC-Segment-Number": "1"}, part)
        else:
            own = {"WARC-Record-ID": f"{rid[:-1]}:{no}>", "WARC-Segment-Origin-ID": rid, "WARC-Segment-Number": str(no), **last}
            yield record({"WARC-Type": "continuation", **common, **own}, part)


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to (null: response).

    Of pages with equal payloads of ``least`` bytes or more, those with the smallest
    page_id are responses. Only digests that come twice are joined back.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("_n"))
    groups = own.where(F.col("_n") >= least).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_k"))
    twice = saved(groups.where((F.col("_k") > 1) & F.col("_first").isNotNull()).select(F.col("digest").alias("_digest"), "_first"), "twice")
    joined = own.join(twice, F.col("digest") == F.col("_digest"), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def archives(plan: DataFrame, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content): archives of about ``archive_bytes``; a task holds one at a time."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = n = no = 0

        def archive() -> pd.DataFrame:
            return pd.DataFrame({"path": [f"pages-{task:06d}-{no:06d}.warc.gz"], "content": [b"".join(held)]})

        for df in parts:
            for page_id, url, html, digest, refers in zip(df["page_id"], df["url"], df["html"], df["digest"], df["refers_to"], strict=True):
                link = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                for r in page_records(f"{task}-{n}", page_id or "", link, html.encode() if refers is None else None, digest, refers, segment_bytes):
                    held.append(r)
                    size += len(r)
                n += 1
                if size >= archive_bytes:
                    yield archive()
                    held, size, no = [], 0, no + 1
        if held:
            yield archive()

    # ids travel as text, so that nulls stay nulls
    rows = plan.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return rows.mapInPandas(write, "path string, content binary")


RECORD = "page_id string, kind string, digest string, id string, refers_to string, n long, place string, segment int, total long, block binary"


def parsed(files: DataFrame) -> DataFrame:
    """The records of archives: whole ones with their payload's size and digest, segments
    with their blocks and their origin's identifier. A digest that differs from the header's
    is an error."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for content in df["content"]:
                rows = []
                for h, block in records(bytes(content)):
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    page = h["x-page-id"] or None
                    segment = int(h.get("warc-segment-number", 0))
                    row = [page, h["warc-type"], digest, h.get("warc-segment-origin-id", h["warc-record-id"]), None, None, None, None, None, None]
                    if h["warc-type"] == "revisit":
                        row[4] = h["warc-refers-to"]
                    elif segment:
                        row[6:] = [h.get("x-place"), segment, int(h.get("warc-segment-total-length", 0)), block]
                    else:
                        payload = payload_of(block)
                        row[5] = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"page {page}: the payload's digest differs from its header")
                    rows.append(row)
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")], dtype=object)
                yield out

    return files.select("content").mapInPandas(read, RECORD)


def reassembled(segments: DataFrame) -> DataFrame:
    """page_id, id, digest, n, complete: a row for every segmented record.

    segments: id (the origin's), place (which of several equal records; may be null). A
    record is complete if its segments are 1..k without gaps and their lengths add up
    to the total that the last one gives; a group is no larger than one record.
    """
    parts = segments.groupBy("id", "place").agg(
        F.min("page_id").alias("page_id"),
        F.min("digest").alias("digest"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    gapless = F.aggregate(F.transform("parts", lambda x, i: x["segment"] == i + 1), F.lit(True), lambda a, x: a & x)
    joined = parts.select("page_id", "id", "digest", (gapless & (size == F.col("total"))).alias("complete"), F.transform("parts", lambda x: x["block"]).alias("blocks"))

    def decode(blocks: pd.Series, complete: pd.Series, digests: pd.Series) -> pd.DataFrame:
        rows = []
        for b, ok, d in zip(blocks, complete, digests, strict=True):
            payload = payload_of(b"".join(b)) if ok else None
            rows.append((len(payload) if ok else None, bool(ok) and hashlib.sha256(payload).hexdigest() == d))
        return pd.DataFrame(rows, columns=["n", "good"])

    got = joined.withColumn("_d", F.pandas_udf(decode, "struct<n: bigint, good: boolean>")("blocks", "complete", "digest"))
    return got.select("page_id", "id", "digest", F.col("_d.n").alias("n"), F.col("_d.good").alias("complete"))


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from (path, content) rows.

    A revisit takes its payload's size and the page from the response it refers to. A record
    whose segments are incomplete, and a revisit whose response isn't there, are errors.
    """
    all_ = saved(parsed(files), "records")
    whole = all_.where((F.col("kind") == "response") & F.col("segment").isNull()).select("page_id", "id", "n", "digest")
    parts = reassembled(all_.where(F.col("segment").isNotNull()))
    checked = F.when(F.col("complete"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("incomplete segments: page "), F.coalesce("page_id", F.lit("")))).cast("long"))
    responses = saved(whole.unionByName(parts.select("page_id", "id", checked.alias("n"), "digest")), "responses")
    revisits = all_.where(F.col("kind") == "revisit").select("page_id", "digest", F.col("refers_to").alias("_to"))
    targets = responses.join(revisits.select("_to").distinct(), F.col("id") == F.col("_to"), "left_semi")
    targets = targets.groupBy("id").agg(F.max("n").alias("n"), F.max("page_id").alias("refers_to"))
    found = revisits.join(targets, F.col("_to") == F.col("id"), "left")
    lost = F.raise_error(F.concat(F.lit("no response "), F.col("_to"))).cast("long")
    revisits = found.withColumn("n", F.when(F.col("id").isNotNull(), F.col("n")).otherwise(lost))
    out = responses.select("page_id", "n", "digest", F.lit("response").alias("kind"), F.lit(None).cast("string").alias("refers_to"))
    out = out.unionByName(revisits.select("page_id", "n", "digest", F.lit("revisit").alias("kind"), "refers_to"))
    return out.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row per page.

    Null html counts as an empty payload; very long payloads are segmented. Rows equal in page_id and payload that could
    refer to each other are all responses. A null page_id never is a group's response
    if another page is. An empty table gives an empty result; other columns are not used,
    whatever their names.
    """
    kind = pages.schema["page_id"].dataType
    got = read_archives(saved(archives(planned(pages.select("page_id", "url", "html"))), "archives"))
    return got.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m"""
