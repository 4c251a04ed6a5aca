"""MPEG transport streams as media columns.

write_stream() multiplexes 8-bit samples into 188-byte packets: program tables, then
elementary packets with time stamps, cut into packets with continuity counters.
read_stream() parses the tables, checks the counters, reassembles the elementary
packets, checks their lengths and lists time stamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import table, text_or_empty

#: Fixed values of the format and of this program.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0, 0x1000, 0x100, 1
PRIVATE_STREAM, STREAM_ID = 0x06, 0xBD
FRAME = 576
#: Frames in an elementary packet; ticks of the 90 kHz clock per frame at 48 kHz.
FRAMES_PER_UNIT, TICKS = 8, 1080
#: A random-access point, with tables before it, comes with every so-many-th unit.
ACCESS_EVERY = 16


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_TABLE = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of table sections (most significant bit first, no final inversion)."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _TABLE[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _tables() -> tuple[bytes, bytes]:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_STREAM]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
    return pat, pmt


PAT, PMT = _tables()


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def write_stream(payload: bytes) -> bytes:
    """payload: a positive multiple of FRAME bytes."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of a frame")
    out, counters = [], {PAT_PID: 0, PMT_PID: 0, STREAM_PID: 0}
    unit = FRAME * FRAMES_PER_UNIT

    def tables() -> None:
        for pid, section in ((PAT_PID, PAT), (PMT_PID, PMT)):
            n = counters[pid]
            counters[pid] = n + 1 & 15
            out.append(bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | n, 0]) + section + b"\xff" * (PACKET - 5 - len(section)))

    count = 0
    heads = [bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x10 | i]) for i in range(16)]
    for no, at in enumerate(range(0, len(payload), unit)):
        part = payload[at : at + unit]
        pts = no * FRAMES_PER_UNIT * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + part
        access = no % ACCESS_EVERY == 0
        if access:
            tables()
        # the first packet of a unit: start flag, and clock and random-access flag at access points
        extra = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big") if access else b""
        room = PACKET - 4 - (len(extra) + 1 if access else 0)
        take = min(room, len(pes))
        out.append(_packet(0x40, count, extra, access, pes[:take]))
        count += 1
        end = take + (len(pes) - take) // 184 * 184
        for p in range(take, end, 184):
            out.append(heads[count & 15] + pes[p : p + 184])
            count += 1
        if end < len(pes):
            out.append(_packet(0, count, b"", False, pes[end:]))
            count += 1
    return b"".join(out)


def _packet(start: int, count: int, extra: bytes, adapted: bool, body: bytes) -> bytes:
    """One stream packet, padded by its adaptation field."""
    pad = PACKET - 4 - len(body)
    head = bytes([SYNC, start | STREAM_PID >> 8, STREAM_PID & 0xFF, (0x30 if pad else 0x10) | count & 15])
    if not pad:
        return head + body
    if pad == 1:
        return head + b"\x00" + body
    flags = extra if adapted else b"\x00"
    return head + bytes([pad - 1]) + flags + b"\xff" * (pad - 1 - len(flags)) + body


@dataclass
class Stream:
    """stamps: (time stamp, packet number, random access) of every elementary packet.
    length_errors: elementary packets with other than the bytes that their header states."""

    payload: bytes = b""
    packets: int = 0
    stamps: list[tuple[int, int, bool]] = field(default_factory=list)
    counter_errors: int = 0
    sync_errors: int = 0
    table_errors: int = 0
    length_errors: int = 0


def _read_section(body: bytes) -> tuple[bytes, bool]:
    at = 1 + body[0]
    size = int.from_bytes(body[at + 1 : at + 3], "big") & 0x0FFF
    section = body[at : at + 3 + size]
    return section, len(section) == 3 + size and section_crc(section) == 0


def read_stream(media: bytes) -> Stream:
    """Reads a stream with one program and one elementary stream.

    Damage is counted, not raised: packets without sync are skipped, a counter that
    doesn't follow is an error, a repeated counter is a duplicate and is skipped, a
    table with a wrong check sum isn't used, and so is an elementary packet that isn't as
    long as its header states (0: any length).
    """
    got = Stream()
    pmt_pid = stream_pid = -1
    last: dict[int, int] = {}
    parts: list[bytes] = []
    # bytes that the elementary packet still lacks; None where its header states none
    lacking: int | None = None
    for number, p in enumerate(range(0, len(media) - PACKET + 1, PACKET)):
        got.packets += 1
        if media[p] != SYNC:
            got.sync_errors += 1
            continue
        pid = (media[p + 1] & 0x1F) << 8 | media[p + 2]
        control = media[p + 3]
        at = p + 4
        access = False
        if control & 0x20:
            size = media[at]
            access = size > 0 and bool(media[at + 1] & 0x40)
            at += 1 + size
        if not control & 0x10:
            continue
        before = last.get(pid)
        last[pid] = count = control & 15
        if before is not None and count != before + 1 & 15:
            if count == before:
                continue
            got.counter_errors += 1
        start = media[p + 1] & 0x40
        if pid == stream_pid:
            if not start:
                parts.append(media[at : p + PACKET])
                if lacking is not None:
                    lacking -= p + PACKET - at
                continue
            got.length_errors += bool(lacking)
            lacking = None
            if media[at : at + 3] != b"\x00\x00\x01":
                got.table_errors += 1
                continue
            skip = at + 9 + media[at + 8]
            if stated := int.from_bytes(media[at + 4 : at + 6], "big"):
                lacking = stated - 3 - media[at + 8] - (p + PACKET - skip)
            s = media[at + 9 : at + 14]
            pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1 if media[at + 7] & 0x80 else -1
            got.stamps.append((pts, number, access))
            parts.append(media[skip : p + PACKET])
        elif pid == PAT_PID and start:
            section, good = _read_section(media[at : p + PACKET])
            got.table_errors += not good
            if good:
                pmt_pid = int.from_bytes(section[10:12], "big") & 0x1FFF
        elif pid == pmt_pid and start:
            section, good = _read_section(media[at : p + PACKET])
            got.table_errors += not good
            if good:
                info = int.from_bytes(section[10:12], "big") & 0x0FFF
                stream_pid = int.from_bytes(section[13 + info : 15 + info], "big") & 0x1FFF
    got.length_errors += bool(lacking)
    got.payload = b"".join(parts)
    return got


def padded(raw: bytes) -> bytes:
    """raw plus bytes 255 up to a positive multiple of FRAME."""
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def stored(texts: pd.Series) -> pd.Series:
    """The transport stream that holds a text's UTF-8 bytes as samples."""
    return pd.Series([write_stream(padded(t.encode())) for t in texts], dtype=object)


STAMPS = "array<struct<pts: bigint, packet: bigint, random_access: boolean>>"
READ = f"payload: binary, packets: bigint, counter_errors: bigint, sync_errors: bigint, table_errors: bigint, length_errors: bigint, stamps: {STAMPS}"


def stamp_rows(x: Stream) -> list[dict]:
    return [{"pts": a, "packet": b, "random_access": c} for a, b, c in x.stamps]


def opened(media: pd.Series) -> pd.DataFrame:
    """What read_stream() finds, for a column of streams."""
    got = [read_stream(bytes(m)) for m in media]
    return pd.DataFrame({
        "payload": [x.payload for x in got],
        "packets": [x.packets for x in got],
        "counter_errors": [x.counter_errors for x in got],
        "sync_errors": [x.sync_errors for x in got],
        "table_errors": [x.table_errors for x in got],
        "length_errors": [x.length_errors for x in got],
        "stamps": [stamp_rows(x) for x in got],
    })


def feature(x: Stream) -> str:
    """Counts of the stream's parts and statistics of its samples, in whole numbers."""
    samples = np.frombuffer(x.payload, dtype=np.uint8)
    n = max(len(samples), 1)
    mean = int(samples.sum(dtype=np.int64)) * 1000 // n
    steps = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)) * 1000 // n
    access = sum(a for _, _, a in x.stamps)
    span = f"{x.stamps[0][0]}-{x.stamps[-1][0]}" if x.stamps else "-"
    return f"packets={x.packets};units={len(x.stamps)};access={access};pts={span};errors={x.counter_errors + x.sync_errors + x.table_errors + x.length_errors};mean={mean};steps={steps}"


DIGESTS = f"payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string, stamps: {STAMPS}"


def digested(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        m = bytes(m)
        x = read_stream(m)
        rows.append((len(x.payload), hashlib.sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(x), stamp_rows(x)))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps"])


def media_column(docs: DataFrame, name: str = "media") -> DataFrame:
    """``docs`` plus a binary column with the transport stream of text (null: empty).

    A column of that name is replaced. Very long texts are stored whole; repeated rows get
    equal streams; an empty table stays empty.
    """
    return docs.withColumn(name, F.pandas_udf(stored, "binary")(text_or_empty()))


def media_opened(media: DataFrame, name: str = "media") -> DataFrame:
    """``media`` plus payload, counts of damage and the time stamps of a stream column.

    Columns of those names are replaced. A null stream has an empty payload and no packets;
    an empty table stays empty.
    """
    found = [x.split(":")[0] for x in READ.replace(STAMPS, "").split(", ")]
    kept = [F.col(f"`{c}`") for c in media.columns if c not in found and c != "_opened"]
    read = F.pandas_udf(opened, f"struct<{READ}>")(F.coalesce(F.col(f"`{name}`"), F.lit(b"")))
    return media.select(*kept, read.alias("_opened")).select(*kept, *[F.col(f"_opened.{c}").alias(c) for c in found])


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, stamps: one row per row of ``docs``.

    stamps holds the time stamp, packet number and random-access flag of every elementary
    packet. Null texts count as empty: one frame of padding. Very long texts are stored
    whole. Equal texts and repeated rows give equal values; an empty table gives an empty
    result; other columns are not used, whatever their names.
    """
    kept = media_column(docs.select("doc_id", "text").withColumn("n_bytes", F.octet_length(text_or_empty()).cast("long"))).drop("text")
    return kept.withColumn("_d", F.pandas_udf(digested, f"struct<{DIGESTS}>")("media")).select("doc_id", "n_bytes", "_d.*")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
