"""Media columns: Matroska files written from bytes and parsed back into packet tables.

The parser walks EBML elements (variable-length ids and sizes), clusters, blocks
with any of the four lacings, and cues; every packet gets its track, time stamp,
cluster and byte range. The writer stores a payload as 8-bit mono PCM and uses
fixed-size lacing for equal frames and EBML lacing for the last, uneven ones.

Empty and null texts become one block of zero bytes (64); equal texts and repeated
rows give equal files, as nothing in a file depends on time or place. Texts of any
length are stored whole, one in a task's memory at a time beside a slice of bounded
size. A damaged file raises ``ValueError`` in ``parse``; the packet table marks it
instead of failing. An empty table gives an empty result. Only the id and the text are
read and nothing else is returned, so other columns' names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.batches import bound, frugal, slices

# Element ids of the public Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
FLAG_LACING, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Samples a second, bytes of a frame, frames of a block and blocks of a cluster that the writer uses.
RATE, FRAME, LACED, PER_CLUSTER = 8000, 512, 8, 8


class Packet(NamedTuple):
    """A frame: its cluster and block (both from 0), track, time in time-stamp units, key flag and bytes [start, end)."""

    cluster: int
    block: int
    track: int
    timestamp: int
    key: bool
    start: int
    end: int


class Media(NamedTuple):
    doc_type: str
    scale_ns: int
    tracks: list[dict]
    clusters: int
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, absolute byte of the cluster


# --- writing


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A size as an EBML variable-length integer; all ones would mean "unknown", so they are left out."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(name: int, body: bytes) -> bytes:
    return _id(name) + vint(len(body)) + body


def _uint(name: int, n: int) -> bytes:
    return _element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes]) -> bytes:
    """The body of a block after its head's first three bytes: flags, lacing, frames."""
    key = 0x80
    if len(frames) == 1:
        return bytes([key]) + frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return bytes([key | 0x04, len(frames) - 1]) + b"".join(frames)
    head = vint(sizes[0])
    for before, now in zip(sizes, sizes[1:-1]):
        step = now - before
        width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
        head += vint(step + (1 << 7 * width - 1) - 1, width)
    return bytes([key | 0x06, len(frames) - 1]) + head + b"".join(frames)


def write(payload: bytes, track: int = 1) -> bytes:
    """``payload`` (at least a byte) as the samples of a one-track file."""
    head = _element(
        EBML,
        _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8)
        + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
    )
    info = _element(
        INFO,
        _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXER, b"weft") + _element(WRITER, b"weft")
        + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)),
    )
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, track) + _uint(TRACK_UID, track) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1)
    tracks = _element(TRACKS, _element(TRACK_ENTRY, entry + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    whole = FRAME * LACED
    for c in range(0, len(payload), whole * PER_CLUSTER):
        base = c * 1000 // RATE
        body = [_uint(CLUSTER_TIMESTAMP, base)]
        for b in range(c, min(c + whole * PER_CLUSTER, len(payload)), whole):
            frames = [payload[k : k + FRAME] for k in range(b, min(b + whole, len(payload)), FRAME)]
            body.append(_element(SIMPLE_BLOCK, vint(track) + struct.pack(">h", b * 1000 // RATE - base) + _lace(frames)))
        parts.append(_element(CLUSTER, b"".join(body)))
        place = _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, track) + _uint(CUE_CLUSTER_POSITION, at))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, base) + place))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(parts))


# --- reading


def _read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise ValueError(f"no element id at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise ValueError(f"bad element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _read_vint(data: bytes, at: int, end: int) -> tuple[int | None, int, int]:
    """Value (None: unknown size), next byte and width."""
    if at >= end or not data[at]:
        raise ValueError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut size at byte {at}")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width, width


#: Elements that end a cluster or segment of unknown size when they come up in it.
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML}


def elements(data: bytes, at: int, end: int, ends_at: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, first byte of the body, end of the body) of each element of a body; of unknown size: up to ``end``."""
    while at < end:
        name, body = _read_id(data, at, end)
        if name in ends_at:
            return
        n, body, _ = _read_vint(data, body, end)
        stop = end if n is None else body + n
        if stop > end:
            raise ValueError(f"element at byte {at} goes beyond byte {end}")
        yield name, body, stop
        if n is None:
            # its real end: the first element of a higher level
            at = body
            while at < end:
                inner, after = _read_id(data, at, end)
                if inner in _TOP:
                    break
                m, after, _ = _read_vint(data, after, end)
                at = end if m is None else after + m
        else:
            at = stop


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _float(data: bytes, at: int, end: int) -> float:
    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0] if end > at else 0.0


def frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and frame byte ranges of a block's body."""
    track, at, _ = _read_vint(data, at, end)
    if at + 3 > end:
        raise ValueError("cut block head")
    when, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    kind = flags & 0x06
    if not kind:
        return track, when, flags, [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 0x04:  # equal sizes
        if (end - at) % count:
            raise ValueError("fixed lacing doesn't divide its block")
        sizes = [(end - at) // count] * count
    elif kind == 0x02:  # runs of 255
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:  # the first size, then signed differences
        n, at, _ = _read_vint(data, at, end)
        sizes.append(n)
        for _ in range(count - 2):
            step, at, width = _read_vint(data, at, end)
            step = (1 << 7 * width) - 1 if step is None else step
            sizes.append(sizes[-1] + step - ((1 << 7 * width - 1) - 1))
    if kind != 0x04:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames go beyond their block")
    found = []
    for n in sizes:
        found.append((at, at + n))
        at += n
    return track, when, flags, found


def parse(data: bytes) -> Media:
    """Packet table, tracks and cues of a whole file."""
    doc_type, scale, tracks, packets, cues, clusters, segment = "", 1_000_000, [], [], [], 0, 0
    for name, at, end in elements(data, 0, len(data)):
        if name == EBML:
            for k, a, b in elements(data, at, end):
                if k == DOC_TYPE:
                    doc_type = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif name == SEGMENT:
            segment = at
            for top, a, b in elements(data, at, end):
                if top == INFO:
                    scale = next((_number(data, x, y) for k, x, y in elements(data, a, b) if k == TIMESTAMP_SCALE), scale)
                elif top == TRACKS:
                    tracks += [_track(data, x, y) for k, x, y in elements(data, a, b) if k == TRACK_ENTRY]
                elif top == CLUSTER:
                    packets += _packets(data, a, b, clusters)
                    clusters += 1
                elif top == CUES:
                    cues += [q for k, x, y in elements(data, a, b) if k == CUE_POINT for q in _cue(data, x, y, segment)]
    if not doc_type:
        raise ValueError("no EBML head")
    return Media(doc_type, scale, tracks, clusters, packets, cues)


def _track(data: bytes, at: int, end: int) -> dict:
    found: dict = {}
    for k, a, b in elements(data, at, end):
        if k in (TRACK_NUMBER, TRACK_TYPE):
            found["number" if k == TRACK_NUMBER else "type"] = _number(data, a, b)
        elif k == CODEC_ID:
            found["codec"] = data[a:b].decode("ascii", "replace")
        elif k == AUDIO:
            for x, c, d in elements(data, a, b):
                if x == SAMPLING_FREQUENCY:
                    found["rate"] = _float(data, c, d)
                elif x in (CHANNELS, BIT_DEPTH):
                    found["channels" if x == CHANNELS else "bits"] = _number(data, c, d)
    return found


def _packets(data: bytes, at: int, end: int, cluster: int) -> list[Packet]:
    base, found, block = 0, [], 0
    for k, a, b in elements(data, at, end, _TOP):
        if k == CLUSTER_TIMESTAMP:
            base = _number(data, a, b)
            continue
        if k == SIMPLE_BLOCK:
            body, key = (a, b), None
        elif k == BLOCK_GROUP:
            body, key = next(((x, y) for i, x, y in elements(data, a, b) if i == BLOCK), None), True
            if body is None:
                continue
        else:
            continue
        track, when, flags, ranges = frames(data, *body)
        found += [Packet(cluster, block, track, base + when, bool(flags & 0x80) if key is None else key, s, e) for s, e in ranges]
        block += 1
    return found


def _cue(data: bytes, at: int, end: int, segment: int) -> list[tuple[int, int, int]]:
    when, places = 0, []
    for k, a, b in elements(data, at, end):
        if k == CUE_TIME:
            when = _number(data, a, b)
        elif k == CUE_TRACK_POSITIONS:
            inner = {i: _number(data, x, y) for i, x, y in elements(data, a, b) if i in (CUE_TRACK, CUE_CLUSTER_POSITION)}
            places.append((inner.get(CUE_TRACK, 0), segment + inner.get(CUE_CLUSTER_POSITION, 0)))
    return [(when, t, p) for t, p in places]


# --- over DataFrames


def payload_of(text: str | bytes | None) -> tuple[int, bytes]:
    """Unpadded length, and the UTF-8 bytes with zeros up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes and media: a Matroska file for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                made = [(n, write(p)) for n, p in map(payload_of, part.column(1).cast(pa.binary()).to_pylist())]
                cols = [part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "media"])

    bound(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    made = docs.select(id_col, text_col).mapInArrow(frugal(run), f"id {kind}, n_bytes long, media binary")
    return made.withColumnRenamed("id", id_col)


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table of each file: a row a frame, with error set (and no packets) where a file is damaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "packet", *Packet._fields, "error"]
        for whole in batches:
            for part in slices(whole, 1):
                rows = []
                for key, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    try:
                        rows += [(key, k, *p, None) for k, p in enumerate(parse(data or b"").packets)]
                    except (ValueError, IndexError, struct.error) as e:
                        rows.append((key, *[None] * (len(names) - 2), str(e)))
                cols = list(zip(*rows)) or [()] * len(names)
                kinds = [part.column(0).type, *[pa.int64()] * 5, pa.bool_(), *[pa.int64()] * 2, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    kind = dict(media.dtypes)[id_col]
    schema = f"id {kind}, packet long, cluster long, block long, track long, timestamp long, key boolean, start long, end long, error string"
    return media.select(id_col, media_col).mapInArrow(frugal(run), schema).withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a file, reads the payload back through the packet table and sums both up.

    feature tells what the parser found: tracks, clusters, blocks, packets,
    cues, the last packet's time and the frame sizes' smallest and largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                rows = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    n, payload = payload_of(text)
                    data = write(payload)
                    got = parse(data)
                    back = b"".join([data[p.start : p.end] for p in got.packets])
                    sizes = [p.end - p.start for p in got.packets]
                    blocks = len({(p.cluster, p.block) for p in got.packets})
                    feature = (
                        f"{got.doc_type} {got.tracks[0]['codec']} tracks={len(got.tracks)} clusters={got.clusters} blocks={blocks} "
                        f"packets={len(sizes)} cues={len(got.cues)} last={got.packets[-1].timestamp} frames={min(sizes)}-{max(sizes)}"
                    )
                    sha = hashlib.sha256
                    rows.append((key, n, len(back), sha(back).hexdigest(), zlib.crc32(back[-64:]), len(data), sha(data).hexdigest(), feature))
                names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                kinds = [part.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    bound(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(id_col, text_col).mapInArrow(frugal(run), schema).withColumnRenamed("id", id_col)
