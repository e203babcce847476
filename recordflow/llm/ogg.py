"""Ogg containers in a binary column: pages, packets, logical streams and times.

Reading checks every page's checksum, rebuilds packets from lacing values across
pages, keeps the logical streams apart by serial number and derives the time of
each packet from granule positions and the rate in the stream's first packet.
Damaged input never raises: a page with a wrong checksum is counted and skipped
(the reader looks for the next capture pattern), and a packet that lost a part is
dropped and counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: Header flags of a page.
CONTINUED, FIRST, LAST = 1, 2, 4
#: First bytes of the sample stream's and the note stream's first packets.
SAMPLES, NOTE = b"\x80pcm8", b"\x80note"
RATE = 8000
#: Bytes of a packet of samples, and serial numbers of the two streams that store() writes.
PACKET, SAMPLE_SERIAL, NOTE_SERIAL = 8192, 1, 2


def checksum(page: bytes) -> int:
    """The container's CRC: polynomial 0x04c11db7, most significant bit first, no inversion.

    The library's CRC takes the same polynomial from the other end, so bytes and result are mirrored.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def write_stream(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream; packets as (bytes, granule position at their end).

    The first packet has a page of its own.  A page whose packets all go on has granule -1.
    """
    out, lacing, body, flags, granule, number = [], bytearray(), bytearray(), FIRST, -1, 0

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, number
        out.append(page(flags | (LAST if last else 0), granule, serial, number, bytes(lacing), bytes(body)))
        lacing, body, granule, number = bytearray(), bytearray(), -1, number + 1

    for k, (data, at) in enumerate(packets):
        pos, left = 0, len(data) // 255 + 1
        while left:
            take = min(left, 255 - len(lacing))
            left -= take
            size = min(len(data) - pos, 255 * take)
            lacing += b"\xff" * (take - (not left)) + (bytes([len(data) % 255]) if not left else b"")
            body += data[pos : pos + size]
            pos += size
            if not left:
                granule = at
            if k == 0 and not left or len(lacing) == 255:
                done = not left and k == len(packets) - 1
                flush(done)
                flags = CONTINUED if left else 0
    if lacing:
        flush(True)
    return out


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of each packet; -1 where the page gives none.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    next_number: int | None = None
    part: bytearray | None = None

    def rate(self) -> int | None:
        """Granules a second, from the first packet of the formats known here."""
        head = self.packets[0] if self.packets else b""
        if head.startswith(SAMPLES) and len(head) >= 9:
            return struct.unpack_from("<I", head, 5)[0] or None
        if head.startswith(b"\x01vorbis") and len(head) >= 16:
            return struct.unpack_from("<I", head, 12)[0] or None
        return 48000 if head.startswith(b"OpusHead") else None

    def lengths(self) -> list[int | None]:
        """Granules of each packet, where its bytes tell: 8-bit samples and Opus frames; headers have none."""
        head = self.packets[0] if self.packets else b""
        if head.startswith(SAMPLES):
            return [0, *map(len, self.packets[1:])]
        if head.startswith(b"OpusHead"):
            return [0, 0, *map(opus_samples, self.packets[2:])][: len(self.packets)]
        return [None] * len(self.packets)

    def ends(self) -> list[int | None]:
        """Granule position at the end of each packet: the page's for its last one, the others counted back from the next, or on from the last."""
        size = self.lengths()
        out = [g if g >= 0 else None for g in self.granules]
        for k in range(len(out) - 2, -1, -1):
            if out[k] is None and out[k + 1] is not None and size[k + 1] is not None:
                out[k] = out[k + 1] - size[k + 1]
        for k in range(1, len(out)):
            if out[k] is None and out[k - 1] is not None and size[k] is not None:
                out[k] = out[k - 1] + size[k]
        return out

    def times(self) -> list[float | None]:
        """Seconds at the end of each packet; null where no granule position, length or rate tells it."""
        rate = self.rate()
        skip = struct.unpack_from("<H", self.packets[0], 10)[0] if self.packets and self.packets[0].startswith(b"OpusHead") and len(self.packets[0]) >= 12 else 0
        return [max(0, g - skip) / rate if rate and g is not None else None for g in self.ends()]


def opus_samples(packet: bytes) -> int | None:
    """Samples at 48 kHz of an Opus packet, from its first byte (and the second, where frames are counted there)."""
    if not packet:
        return 0
    config, code = packet[0] >> 3, packet[0] & 3
    if config < 12:
        frame = (480, 960, 1920, 2880)[config & 3]
    elif config < 16:
        frame = (480, 960)[config & 1]
    else:
        frame = (120, 240, 480, 960)[config & 3]
    if code == 3 and len(packet) < 2:
        return None
    return frame * (packet[1] & 63 if code == 3 else min(code + 1, 2))


@dataclass
class Media:
    streams: dict[int, Stream] = field(default_factory=dict)
    bad_checksums: int = 0
    lost_packets: int = 0


def read(data: bytes) -> Media:
    """All logical streams of a container, demultiplexed."""
    out, at = Media(), 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > len(data):
            break
        _, version, flags, granule, serial, number, crc, count = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        whole = data[at:end]
        if version or len(lacing) < count or end > len(data) or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            out.bad_checksums += 1
            at += 4
            continue
        s = out.streams.setdefault(serial, Stream(serial))
        if s.next_number is not None and number != s.next_number or not flags & CONTINUED:
            out.lost_packets += s.part is not None
            s.part = None
        skipping = bool(flags & CONTINUED) and s.part is None
        s.pages, s.next_number, s.ended = s.pages + 1, number + 1, bool(flags & LAST)
        pos, size, first = at + 27 + count, 0, len(s.packets)
        for k, value in enumerate(lacing):
            size += value
            if value < 255 or k == count - 1:
                piece = data[pos : pos + size]
                pos, size = pos + size, 0
                if skipping:
                    skipping = value == 255
                    out.lost_packets += value < 255
                elif value == 255:
                    s.part = (s.part or bytearray()) + piece
                else:
                    s.packets.append(bytes(s.part) + piece if s.part else piece)
                    s.granules.append(-1)
                    s.part = None
        if len(s.packets) > first:
            s.granules[-1] = granule
        at = end
    out.lost_packets += sum(s.part is not None for s in out.streams.values())
    return out


def store(payload: bytes) -> bytes:
    """A payload as 8-bit samples in one logical stream, its length as a note in a second one."""
    head = SAMPLES + struct.pack("<I", RATE)
    packets = [(head, 0)] + [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    samples = write_stream(packets, SAMPLE_SERIAL)
    note = write_stream([(NOTE, 0), (str(len(payload)).encode(), 0)], NOTE_SERIAL)
    return b"".join([samples[0], note[0], *samples[1:2], note[1], *samples[2:]])


def restore(media: Media) -> bytes:
    """The samples back; an error if they aren't as many as the note says."""
    payload = b"".join(media.streams[SAMPLE_SERIAL].packets[1:])
    if int(media.streams[NOTE_SERIAL].packets[1]) != len(payload):
        raise ValueError("samples are missing")
    return payload


def features(media: Media, payload: bytes) -> str:
    """Counts, duration and simple statistics of the samples around 128."""
    s = media.streams[SAMPLE_SERIAL]
    x = np.frombuffer(payload, np.uint8)
    signs = x >= 128
    ends = [t for t in s.times() if t is not None]
    return ";".join(
        [
            f"streams={len(media.streams)}",
            f"pages={sum(t.pages for t in media.streams.values())}",
            f"packets={sum(len(t.packets) for t in media.streams.values())}",
            f"seconds={max(ends, default=0.0):.6f}",
            f"mean={int(x.sum(dtype=np.int64)) / len(x) - 128:.4f}",
            f"crossings={int(np.count_nonzero(signs[1:] != signs[:-1]))}",
            f"bad={media.bad_checksums}",
            f"lost={media.lost_packets}",
        ]
    )


def media_features(docs: DataFrame) -> DataFrame:
    """Stores each text as Ogg samples, reads the bytes back, and describes them.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature.  A null text counts as empty: 64 zero bytes.  Equal
    texts give equal values.  Other columns are ignored; every row gives a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                raw = raw or b""
                data = store(raw + bytes(-len(raw) % 64 if raw else 64))
                media = read(data)
                payload = restore(media)
                out.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(media, payload)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def packet_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """(key, serial, packet, seconds, bytes) for every packet of every container in a binary column.

    A null or damaged value gives the packets that can be rebuilt, perhaps none.
    """
    kind = media.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(1).to_pylist()):
                found = read(data or b"")
                rows = [(s.serial, i, t, p) for s in found.streams.values() for i, (t, p) in enumerate(zip(s.times(), s.packets, strict=True))]
                if rows:
                    serial, number, seconds, body = zip(*rows, strict=True)
                    keys = batch.column(0).take(pa.array([k] * len(rows)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(serial, pa.int64()), pa.array(number, pa.int64()), pa.array(seconds, pa.float64()), pa.array(body, pa.binary())], names=["key", "serial", "packet", "seconds", "bytes"])

    return media.selectExpr(f"`{key}` as key", f"`{column}` as data").mapInArrow(run, f"key {kind.simpleString()}, serial bigint, packet bigint, seconds double, bytes binary")
