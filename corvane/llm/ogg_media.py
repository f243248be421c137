"""Media columns: byte payloads as 8-bit samples in Ogg streams.

``pack`` lays a payload into packets of PACKET samples of one logical stream, beside a second one that describes it, and both
into pages; ``unpack`` verifies page checksums and sequence numbers, tells the streams apart by serial number, reassembles
packets from lacing values, also over page borders, and takes time from granule positions (samples so far, RATE a second).

The serial numbers come from the payload, so equal texts have equal media. Null text counts as empty; an empty text has a
payload of 64 zero bytes. Repeated rows give repeated rows. Other columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import apart, arrow_map, text_or_empty, work_path

RATE, PACKET, PAGE_SEGMENTS, BLOCK = 8000, 1024, 128, 64
CONTINUED, FIRST, LAST, NO_GRANULE = 1, 2, 4, (1 << 64) - 1
SAMPLES, NOTES = b"\x01pcm8bit", b"\x01notes\0\0"
_HEADER = struct.Struct("<4sBBQIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32 (0x04c11db7, highest bit first, from zero): zlib's of the mirrored bytes, mirrored."""
    x = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_MIRROR), "big")


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing))
    whole = head + lacing + body
    return head[:22] + struct.pack("<I", page_checksum(whole)) + whole[26:]


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """packets: (bytes, granule position at its end). The first stands alone on its page."""
    out: list[bytes] = []
    lacing, body, granule, continued = bytearray(), bytearray(), NO_GRANULE, False

    def close(last: bool, more: bool) -> None:
        nonlocal lacing, body, granule, continued
        flags = CONTINUED * continued | FIRST * (not out) | LAST * last
        out.append(page(flags, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, continued = bytearray(), bytearray(), NO_GRANULE, more

    for k, (data, end) in enumerate(packets):
        whole, rest = divmod(len(data), 255)
        at = 0
        for value in [*(255 for _ in range(whole)), rest]:
            if len(lacing) == PAGE_SEGMENTS:
                close(False, at > 0)
            lacing.append(value)
            body += data[at : at + value]
            at += value
        granule = end
        if k == 0 and len(packets) > 1:
            close(False, False)
    close(True, False)
    return out


def pack(payload: bytes) -> bytes:
    """The payload as an Ogg file of two logical streams, their pages in turn."""
    serial = zlib.crc32(payload) | 1
    samples = [(SAMPLES + struct.pack("<IQ", RATE, len(payload)), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    notes = [(NOTES, 0), (f"samples={len(payload)};rate={RATE}".encode(), len(payload))]
    one, two = pages(serial, samples), pages(serial ^ 1, notes)
    return b"".join([one[0], two[0], *one[1:-1], *two[1:], one[-1]])


class Packet(NamedTuple):
    data: bytes
    seconds: float | None  # at its end; known for the last packet that ends on a page


def demultiplex(media: bytes) -> dict[int, list[Packet]]:
    """The packets of each logical stream, by serial number. ValueError if a page is damaged, missing or out of order."""
    streams: dict[int, list[Packet]] = {}
    part: dict[int, bytearray] = {}
    following: dict[int, int] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEADER.size:
            raise ValueError(f"a page is cut short at {at}")
        magic, version, flags, granule, serial, sequence, checksum, n = _HEADER.unpack_from(media, at)
        start = at + _HEADER.size + n
        lacing = media[at + _HEADER.size : start]
        end = start + sum(lacing)
        if magic != b"OggS" or version or end > len(media):
            raise ValueError(f"no page at {at}")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != checksum:
            raise ValueError(f"a checksum is wrong at {at}")
        if sequence != following.get(serial, 0) or bool(flags & FIRST) != (serial not in streams) or bool(flags & CONTINUED) != bool(part.get(serial)):
            raise ValueError(f"a page is missing before {at}")
        following[serial] = sequence + 1
        done, data, p = streams.setdefault(serial, []), part.get(serial) or bytearray(), start
        ended = [i for i, v in enumerate(lacing) if v < 255]
        for i, v in enumerate(lacing):
            data += media[p : p + v]
            p += v
            if v < 255:
                done.append(Packet(bytes(data), granule / RATE if i == ended[-1] and granule != NO_GRANULE else None))
                data = bytearray()
        part[serial] = data
        at = end
    if any(part.values()):
        raise ValueError("a packet does not end")
    return streams


def unpack(media: bytes) -> tuple[bytes, list[Packet]]:
    """The payload and the packets of the stream of samples."""
    for packets in demultiplex(media).values():
        if packets[0].data.startswith(SAMPLES):
            payload = b"".join([p.data for p in packets[1:]])
            if len(payload) != struct.unpack("<IQ", packets[0].data[len(SAMPLES) :])[1]:
                raise ValueError("samples are missing")
            return payload, packets
    raise ValueError("there is no stream of samples")


def feature(payload: bytes, packets: list[Packet]) -> str:
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    rms = float(np.sqrt((x * x).sum() / len(x)))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    seconds = max(p.seconds for p in packets if p.seconds is not None)
    return f"packets={len(packets)};seconds={seconds:.6f};peak={int(np.abs(x).max())};rms={rms:.6f};crossings={crossings}"


RESULTS = ("n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def store(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Write a table of keep, n_bytes (UTF-8 bytes of the text) and media, and read it again."""
    columns, keep = apart(df, keep, *RESULTS, "text")
    df = df.select(*columns, text_or_empty(text).alias("text"))
    types = dict(df.dtypes)

    def make():
        def work(*columns):
            return [*columns[:-1], [len(t.encode()) for t in columns[-1]], [pack(payload_of(t)) for t in columns[-1]]]

        return work

    out = arrow_map(df, df.columns, ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_bytes long, media binary"]), make)
    out.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def examine(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """keep with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all from the stored bytes."""
    types = dict(stored.dtypes)

    def make():
        def work(*columns):
            got = [unpack(m) for m in columns[-1]]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return [*columns[:-1], [len(p) for p, _ in got], [sha(p) for p, _ in got], [zlib.crc32(p[-BLOCK:]) for p, _ in got], [len(m) for m in columns[-1]], [sha(m) for m in columns[-1]], [feature(*g) for g in got]]

        return work

    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"])
    return arrow_map(stored, [*keep, "media"], schema, make)


def roundtrip(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row for each row of df: the columns of ``keep`` (one that is named like a result gets underscores before its name), and what
    store() and examine() give of its text. Null counts as empty; repeated rows give repeated rows."""
    stored = store(df, work_path(df.sparkSession, "ogg"), keep, text)
    return examine(stored, tuple(c for c in stored.columns if c != "media"))
