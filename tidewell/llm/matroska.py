"""Media columns in Matroska: payloads stored as 8-bit sample tracks, parsed back into packet tables.

:func:`store` writes a payload as a Matroska file, :func:`parse` walks any file's EBML elements (variable-length ids and
sizes, unknown sizes, clusters, simple and grouped blocks, all four lacings, cues) into tracks, packets and cues.
:func:`with_media` adds a media column to documents, :func:`packets` makes the packet table of a media column: one row
per packet with its track, timestamp in nanoseconds, key flag, lacing and byte range, and :func:`features` reads every
media value back and returns its digests.

A null text counts as empty; its payload is one unit of 64 zero bytes. A null media value has no packets and no
features row values (nulls). A damaged file raises ValueError in :func:`parse`; the column operators report it in
``error`` and give what came before. Repeated rows are each handled; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bounded


# The container's element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, TYPE, CODEC, LACING, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE, GROUP, BLOCK, LENGTH = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, POINT, CUE_PLACES}
LACES = ("none", "xiph", "fixed", "ebml")

UNIT, FRAME, PER_BLOCK, BLOCKS_PER_CLUSTER, SAMPLE_RATE = 64, 1024, 6, 4, 8000
TICK = 1_000_000_000 // SAMPLE_RATE


def _size(n: int) -> bytes:
    """A size as the shortest variable-length integer; all ones are left for unknown sizes."""
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    """Frames of a block with the sizes that the lacing states in front."""
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif lacing == 3:
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:]):  # differences, moved so that they are positive
            k = 1
            while abs(b - a) >= (1 << 7 * k - 1) - 1:
                k += 1
            head += (b - a + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")
    return head + b"".join(frames)


def store(payload: bytes) -> bytes:
    """A Matroska file whose one track of 8-bit mono samples is the payload, in frames of FRAME samples.

    Blocks hold up to PER_BLOCK frames with the lacing that suits them (one frame: none; equal frames: fixed; else the
    cheaper of the other two), the last block is a group with a duration, and every cluster has a cue."""
    head = _element(EBML, _uint(VERSION, 1) + _uint(READ_VERSION, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
    info = _element(INFO, _uint(SCALE, TICK) + _element(DURATION, struct.pack(">d", len(payload))) + _element(MUXER, b"tidewell") + _element(WRITER, b"tidewell"))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    track = _uint(NUMBER, 1) + _uint(UID, 1) + _uint(TYPE, 2) + _uint(LACING, 1) + _element(CODEC, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, FRAME * TICK) + audio
    parts = [info, _element(TRACKS, _element(TRACK, track))]
    at, points = sum(map(len, parts)), []
    step = FRAME * PER_BLOCK
    for start in range(0, len(payload), step * BLOCKS_PER_CLUSTER):
        body = [_uint(TIMESTAMP, start)]
        for lo in range(start, min(start + step * BLOCKS_PER_CLUSTER, len(payload)), step):
            frames = [payload[i : min(i + FRAME, lo + step)] for i in range(lo, min(lo + step, len(payload)), FRAME)]
            even = len({len(f) for f in frames}) == 1
            lacing = 0 if len(frames) == 1 else 2 if even else 1 if len(frames) == 2 else 3
            last = lo + step >= len(payload)
            block = b"\x81" + struct.pack(">hB", lo - start, lacing << 1 | (0 if last else 0x80)) + _laced(frames, lacing)
            body.append(_element(GROUP, _element(BLOCK, block) + _uint(LENGTH, sum(map(len, frames)))) if last else _element(SIMPLE, block))
        parts.append(_element(CLUSTER, b"".join(body)))
        points.append(_element(POINT, _uint(CUE_TIME, start) + _element(CUE_PLACES, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return head + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(points)))


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)  # track, timestamp ns, key, lacing, start, length
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time ns, track, start of the cluster
    clusters: list[int] = field(default_factory=list)


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """Variable-length integer and the place after it; ``keep`` leaves the length marker in, as ids have it."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    k = 9 - data[at].bit_length()
    if at + k > len(data):
        raise ValueError(f"file ends inside the integer at byte {at}")
    n = int.from_bytes(data[at : at + k], "big")
    if keep:
        return n, at + k
    n -= 1 << 7 * k
    return (-1 if n == (1 << 7 * k) - 1 else n), at + k


def parse(data: bytes, into: Media | None = None) -> Media:
    """Tracks, packets and cues of a file. An element of unknown size ends where a sibling of its parent begins. Whatever
    is wrong with the file, the error is a ValueError, and ``into`` holds what came before it."""
    m = into if into is not None else Media()
    try:
        return _walk(data, m)
    except (IndexError, struct.error) as e:
        raise ValueError(f"damaged file: {e}") from e


def seek(m: Media, time_ns: int, track: int) -> list[tuple]:
    """Packets of a track from a time on, found through the cues: only those at or after the cluster of the track's last cue
    up to that time are looked at; without such a cue, all are."""
    places = [place for time, number, place in m.cues if number == track and time <= time_ns]
    first = max(places, default=0)
    return [p for p in m.packets[bisect_left(m.packets, first, key=lambda p: p[4]) :] if p[0] == track and p[1] >= time_ns]


def _walk(data: bytes, m: Media) -> Media:
    top, cluster_time, track, point, place = 0, 0, None, [0, 0, 0], 0
    ends: list[tuple[int, int]] = []  # of the open parents: id and end, -1 if unknown
    at = 0
    while at < len(data):
        while ends and ends[-1][1] >= 0 and at >= ends[-1][1]:
            ends.pop()
        start = at
        ident, at = _vint(data, at, True)
        size, at = _vint(data, at, False)
        if ident in (CLUSTER, CUES, INFO, TRACKS) and ends and ends[-1] == (CLUSTER, -1):
            ends.pop()
        if ident in PARENTS:
            if ident == SEGMENT:
                top = at
            elif ident == CLUSTER:
                m.clusters.append(start)
            elif ident == TRACK:
                track = {}
            elif ident == POINT:
                place = 0
            ends.append((ident, at + size if size >= 0 else -1))
            continue
        if size < 0 or at + size > len(data):
            raise ValueError(f"element {ident:x} at byte {start} goes beyond the file")
        body, at = data[at : at + size], at + size
        if ident == SCALE:
            m.scale = int.from_bytes(body, "big")
        elif ident == TIMESTAMP:
            cluster_time = int.from_bytes(body, "big")
        elif track is not None and ident in (NUMBER, TYPE, DEFAULT_DURATION, CHANNELS, DEPTH, CODEC, RATE):
            track[ident] = body.decode("ascii", "replace") if ident == CODEC else struct.unpack(">d" if size == 8 else ">f", body)[0] if ident == RATE else int.from_bytes(body, "big")
            if ident == NUMBER:
                m.tracks[track[ident]] = track
        elif ident in (SIMPLE, BLOCK):
            _block(m, body, at - size, cluster_time, ident == SIMPLE)
        elif ident == CUE_TIME:
            point[0] = int.from_bytes(body, "big") * m.scale
        elif ident == CUE_TRACK:
            place = int.from_bytes(body, "big")
        elif ident == CUE_CLUSTER:
            m.cues.append((point[0], place, top + int.from_bytes(body, "big")))
    return m


def _block(m: Media, body: bytes, base: int, cluster_time: int, simple: bool) -> None:
    number, at = _vint(body, 0, False)
    if at + 3 > len(body):
        raise ValueError(f"block at byte {base} has no head")
    when, flags = struct.unpack(">hB", body[at : at + 3])
    at, lacing = at + 3, flags >> 1 & 3
    sizes: list[int] = []
    if lacing:
        count, at = body[at] + 1, at + 1
        if lacing == 2:
            sizes = [(len(body) - at) // count] * (count - 1)
        for i in range(count - 1 if lacing != 2 else 0):
            if lacing == 1:
                n = 0
                while body[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + body[at], at + 1
            else:
                k = at
                n, at = _vint(body, at, False)
                if i:
                    n += sizes[-1] - ((1 << 7 * (at - k) - 1) - 1)
            sizes.append(n)
    sizes.append(len(body) - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"laced sizes at byte {base} exceed their block")
    each = m.tracks.get(number, {}).get(DEFAULT_DURATION, 0)
    for i, n in enumerate(sizes):
        m.packets.append((number, (cluster_time + when) * m.scale + i * each, bool(simple and flags & 0x80), LACES[lacing], base + at, n))
        at += n


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length and the payload: UTF-8 with zero bytes up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media (the text's payload as a Matroska file) of ``docs`` (doc_id, text, ...)."""

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [payload_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [n for n, _ in made], "media": [store(p) for _, p in made]})

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(ids).mapInPandas(stored, "doc_id long, n_bytes long, media binary")


def _read(media: bytes | None) -> tuple[Media, str | None]:
    m = Media()
    try:
        parse(bytes(media), m) if media is not None else None
    except ValueError as e:
        return m, str(e)
    return m, None


def packets(media: DataFrame) -> DataFrame:
    """Packet table of ``media`` (doc_id, media): doc_id, packet (from 0), track, timestamp_ns, key, lacing, start, length."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, *p) for d, b in zip(pdf["doc_id"], pdf["media"]) for i, p in enumerate(_read(b)[0].packets)]
            yield pd.DataFrame(rows, columns=["doc_id", "packet", "track", "timestamp_ns", "key", "lacing", "start", "length"])

    return bounded(media.select("doc_id", "media")).mapInPandas(read, "doc_id long, packet long, track long, timestamp_ns long, key boolean, lacing string, start long, length long")


def features(media: DataFrame) -> DataFrame:
    """Digests of ``media`` (doc_id, n_bytes, media), the payload put together from the packets' byte ranges: doc_id,
    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, n, media in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"]):
                if media is None:
                    rows.append((doc, n, None, None, None, None, None, None, None))
                    continue
                m, error = _read(media)
                payload = b"".join(media[s : s + k] for *_, s, k in m.packets)
                laces = {x: sum(p[3] == x for p in m.packets) for x in LACES}
                cued = sum(place in m.clusters for _, _, place in m.cues)
                level = sum(payload) / max(1, len(payload))
                said = f"packets={len(m.packets)};clusters={len(m.clusters)};cues={cued};last_ns={m.packets[-1][1] if m.packets else 0};" + ";".join(f"{x}={c}" for x, c in laces.items()) + f";mean={level:.3f}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), said, error))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    shape = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return bounded(media.select("doc_id", "n_bytes", "media")).mapInPandas(read, shape)
