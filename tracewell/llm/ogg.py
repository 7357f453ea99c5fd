"""Media columns as Ogg: texts' bytes stored as 8-bit samples in paged, checksummed streams.

A container holds two logical streams whose pages alternate: samples (a header packet, then
packets of 4000 samples) and an index (one packet with the unpadded length). Packets are laced
into pages of at most 255 segments and run on into the next page where one is full. Reading
verifies every page's checksum and number, demultiplexes by serial number, reassembles packets
from lacing values and takes times from granule positions, which count samples.

Defined cases: a null text is an empty one; its payload is 64 zero samples. Serial numbers are
fixed, so equal texts, and repeated rows, give equal containers. A very long text is one container of
its task, whole. There are no ties; an empty table gives no rows; columns besides doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ship, spread

#: Fixed values of the Ogg page layout.
CAPTURE = b"OggS"
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

SAMPLES, INDEX = 1, 2
RATE = 8000
PACKET = 4000
_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7 from 0, most significant bit first: the reflected one of zlib over turned bits, turned back."""
    low = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(_TURNED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    raw = PAGE.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream from (packet, granule position at its end); the header packet has a page of its own."""
    number, lacing, body, granule, flags = 0, bytearray(), [], -1, FIRST
    for k, (packet, end) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while at < len(values):
            room = 255 - len(lacing)
            part = values[at : at + room]
            lacing += part
            body.append(packet[255 * at : 255 * (at + len(part))])
            at += len(part)
            if at == len(values):
                granule = end
            last = k == len(packets) - 1 and at == len(values)
            if len(lacing) == 255 or last or (k == 0 and at == len(values)):
                yield _page(flags | (LAST if last else 0), granule, serial, number, bytes(lacing), b"".join(body))
                number, lacing, body, granule = number + 1, bytearray(), [], -1
                flags = CONTINUED if at < len(values) else 0


def write(payload: bytes, n_bytes: int) -> bytes:
    head = b"TWPCM8\0\0" + struct.pack("<II", RATE, PACKET)
    audio = pages(SAMPLES, [(head, 0), *((payload[k : k + PACKET], min(len(payload), k + PACKET)) for k in range(0, len(payload), PACKET))])
    index = pages(INDEX, [(b"TWINDEX\0" + struct.pack("<Q", n_bytes), len(payload))])
    return b"".join([next(audio), *index, *audio])


def read(raw: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets and the granule positions of their pages, by serial number; ValueError where a container is damaged."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    state: dict[int, tuple[int, list[bytes], bool]] = {}
    at = 0
    while at < len(raw):
        if at + PAGE.size > len(raw):
            raise ValueError("a page is cut short")
        capture, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(raw, at)
        if capture != CAPTURE or version:
            raise ValueError("no page where one is due")
        lacing = raw[at + PAGE.size : at + PAGE.size + n]
        end = at + PAGE.size + n + sum(lacing)
        page = raw[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("a page's checksum differs")
        due, open_, ended = state.get(serial, (0, [], False))
        if number != due or ended or bool(flags & CONTINUED) != bool(open_) or bool(flags & FIRST) != (due == 0):
            raise ValueError("a stream's pages are out of order")
        body, pos = at + PAGE.size + n, 0
        packets = streams.setdefault(serial, [])
        run = 0
        for v in lacing:
            run += v
            if v < 255:
                open_.append(raw[body + pos : body + pos + run])
                packets.append((b"".join(open_), granule))
                pos, run, open_ = pos + run, 0, []
        if run:
            open_.append(raw[body + pos : body + pos + run])
        state[serial] = (number + 1, open_, bool(flags & LAST))
        at = end
    if any(open_ or not ended for _, open_, ended in state.values()):
        raise ValueError("a stream has no end")
    return streams


def samples(raw: bytes) -> tuple[np.ndarray, int, float]:
    """The 8-bit samples, the unpadded length and the duration in seconds of a container."""
    streams = read(raw)
    head, body = streams[SAMPLES][0][0], streams[SAMPLES][1:]
    rate, _ = struct.unpack("<II", head[8:16])
    data = b"".join(p for p, _ in body)
    if body[-1][1] != len(data):
        raise ValueError("granule positions do not count the samples")
    return np.frombuffer(data, np.uint8), struct.unpack("<Q", streams[INDEX][0][0][8:])[0], body[-1][1] / rate


def feature(x: np.ndarray, seconds: float) -> str:
    """Duration, mean, deviation, share of sign changes about the middle, and a coarse histogram."""
    signed = x.astype(np.int16) - 128
    turns = np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0))
    bars = np.bincount(x >> 5, minlength=8) / len(x)
    return f"{seconds:.6f}s mean={signed.mean():.4f} dev={signed.std():.4f} turns={turns / max(1, len(x) - 1):.6f} bars=" + ",".join(f"{b:.4f}" for b in bars)


def media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """The digests of every row's container, after it is read back; with `media`, the container itself."""
    ship(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("duration_s", pa.float64()), ("media", pa.binary())]
    fields = fields if keep_media else fields[:-1]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double" + ", media binary" * keep_media

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some, out = batch.slice(lo, 256), []
                for name, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    data = text.encode()
                    raw = write(data + b"\0" * (-len(data) % 64 or (0 if data else 64)), len(data))
                    x, n, seconds = samples(raw)
                    back = x.tobytes()
                    out.append((name, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(x, seconds), seconds, raw)[: len(fields)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[f for f, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).transform(spread).mapInArrow(work, schema)
