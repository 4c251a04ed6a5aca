import hashlib
import zlib

import pytest

from gradeloom.llm import mpegts as M


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 4608, 4609, 100_000])
def test_exact_round_trip(n):
    p = M.padded(bytes(i * 7 % 256 for i in range(n)))
    m = M.write_stream(p)
    x = M.read_stream(m)
    assert x.payload == p and len(m) % M.PACKET == 0 and len(p) % M.FRAME == 0
    assert (x.counter_errors, x.sync_errors, x.table_errors) == (0, 0, 0)
    units = -(-len(p) // (M.FRAME * M.FRAMES_PER_UNIT))
    assert [s[0] for s in x.stamps] == [i * M.FRAMES_PER_UNIT * M.TICKS for i in range(units)]
    assert [s[2] for s in x.stamps] == [i % M.ACCESS_EVERY == 0 for i in range(units)]
    assert all(m[s[1] * M.PACKET] == M.SYNC for s in x.stamps)


def test_section_crc_is_the_published_one():
    assert M.section_crc(b"123456789") == 0x0376E6E7


def test_damage_is_counted():
    m = M.write_stream(M.padded(b"a" * 30_000))
    lost = m[: 10 * M.PACKET] + m[11 * M.PACKET :]
    assert M.read_stream(lost).counter_errors == 1
    twice = m[: 11 * M.PACKET] + m[10 * M.PACKET : 11 * M.PACKET] + m[11 * M.PACKET :]
    assert M.read_stream(twice).payload == M.read_stream(m).payload
    broken = bytearray(m)
    broken[5 * M.PACKET] = 0
    assert M.read_stream(bytes(broken)).sync_errors == 1
    broken = bytearray(m)
    broken[10] ^= 255  # inside the first table
    assert M.read_stream(bytes(broken)).table_errors == 1
    with pytest.raises(ValueError):
        M.write_stream(b"abc")


def test_lengths_are_checked():
    m = M.write_stream(M.padded(b"a" * 30_000))
    assert M.read_stream(m).length_errors == 0
    # a lost packet within an elementary packet: it is short of what its header states
    lost = m[: 10 * M.PACKET] + m[11 * M.PACKET :]
    assert M.read_stream(lost).length_errors == 1
    # the last one is cut short
    assert M.read_stream(m[: -M.PACKET]).length_errors == 1
    # sixteen packets lost: the counters agree again, the length doesn't
    x = M.read_stream(m[: 6 * M.PACKET] + m[22 * M.PACKET :])
    assert x.counter_errors == 0 and x.length_errors == 1
    broken = bytearray(m)
    at = M.read_stream(m).stamps[1][1] * M.PACKET + 4
    assert broken[at : at + 3] == b"\x00\x00\x01"
    broken[at + 5] ^= 1  # the stated length
    assert M.read_stream(bytes(broken)).length_errors == 1


def test_query(spark, odd_docs, odd_rows, clashing, no_docs):
    want = set()
    for r in odd_rows:
        raw = (r[1] or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.add((r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    got = M.media_digests(odd_docs)
    rows = got.collect()
    assert len(rows) == len(odd_rows) and {tuple(r)[:5] for r in rows} == want
    long = next(r for r in rows if r["doc_id"] == 8)
    unit = M.FRAME * M.FRAMES_PER_UNIT
    assert [(s["pts"], s["random_access"]) for s in long["stamps"]] == [(i * M.FRAMES_PER_UNIT * M.TICKS, i % M.ACCESS_EVERY == 0) for i in range(-(-long["payload_bytes"] // unit))]
    flat = lambda df: sorted(map(repr, df.collect()))
    assert flat(M.media_digests(clashing)) == flat(got) and M.media_digests(no_docs).count() == 0
    more = clashing.selectExpr("*", "'x' as payload", "'y' as stamps", "'z' as packets", "1 as _opened")
    clash = M.media_opened(M.media_column(more))
    assert len(set(clash.columns)) == len(clash.columns) and bytes(clash.where("doc_id = 9").head()["payload"]).startswith(b"one two")
    none = M.media_opened(clashing.selectExpr("doc_id", "cast(null as binary) as media")).head()
    assert bytes(none["payload"]) == b"" and none["packets"] == 0 and none["stamps"] == []
    opened = M.media_opened(M.media_column(odd_docs)).where("doc_id = 9").head()
    assert bytes(opened["payload"]).rstrip(b"\xff") == b"one two" and opened["stamps"][0]["random_access"]
