import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import matroska as m


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=40_000))
def test_payload_round_trip(payload):
    data = m.write(payload)
    got = m.parse(data)
    assert b"".join(data[p.start : p.end] for p in got.packets) == payload
    assert len(got.cues) == got.clusters == 1 + max(p.cluster for p in got.packets)
    for when, track, at in got.cues:
        assert track == 1 and int.from_bytes(data[at : at + 4], "big") == m.CLUSTER
        assert when == min(p.timestamp for p in got.packets if p.cluster == got.cues.index((when, track, at)))


def test_all_lacings():
    body = bytes(range(60))
    no = b"\x81\x00\x05\x80" + body
    assert m.frames(no, 0, len(no)) == (1, 5, 0x80, [(4, 64)])
    fixed = b"\x81\x00\x05\x84\x03" + body
    assert m.frames(fixed, 0, len(fixed))[3] == [(5, 20), (20, 35), (35, 50), (50, 65)]
    xiph = b"\x81\x00\x05\x82\x02" + bytes([255, 10, 20]) + bytes(265 + 20 + 7)
    assert [b - a for a, b in m.frames(xiph, 0, len(xiph))[3]] == [265, 20, 7]
    ebml = b"\x81\xff\xfe\x86\x02" + m.vint(800) + b"\x5e\xd3" + bytes(800 + 500 + 9)  # the difference -300
    track, when, flags, ranges = m.frames(ebml, 0, len(ebml))
    assert (track, when) == (1, -2) and [b - a for a, b in ranges] == [800, 500, 9]


def test_unknown_sizes_and_block_groups():
    block = m._element(m.BLOCK_GROUP, m._element(m.BLOCK, b"\x82\x00\x01\x00abc") + m._uint(m.BLOCK_DURATION, 9))
    live = m._id(m.CLUSTER) + b"\xff" + m._uint(m.CLUSTER_TIMESTAMP, 100) + block
    data = m._element(m.EBML, m._element(m.DOC_TYPE, b"webm")) + m._id(m.SEGMENT) + b"\x01" + b"\xff" * 7 + live + live
    got = m.parse(data)
    assert got.doc_type == "webm" and got.clusters == 2
    assert [(p.cluster, p.track, p.timestamp, data[p.start : p.end]) for p in got.packets] == [(0, 2, 101, b"abc"), (1, 2, 101, b"abc")]


@pytest.mark.parametrize("bad", [b"", b"\x00", b"\x1a\x45\xdf\xa3\x9f", b"text"])
def test_damage_is_an_error(bad):
    with pytest.raises(ValueError):
        m.parse(bad)


def test_digest_and_packets(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "é" * 40, 0), (4, "x" * 200_000, 0), (4, "x" * 200_000, 0), (None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = m.digest(docs).collect()
    assert len(got) == len(rows)
    for r, (_, text, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), rows):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(m.write(payload)) and r.media_sha256 == hashlib.sha256(m.write(payload)).hexdigest()
    table = m.packets(m.encode(docs)).filter("doc_id = 3").collect()
    assert [(p.packet, p.error, p.end - p.start) for p in table] == [(0, None, 128)]
    damaged = spark.createDataFrame([(1, b"zz")], "doc_id long, media binary")
    assert m.packets(damaged).first().error
    assert m.digest(docs.limit(0)).count() == 0
