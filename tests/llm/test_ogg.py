"""Round trips, damage and the checksum against a bit-by-bit version."""

import random

from recordflow.llm import ogg


def slow_checksum(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 5, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


def test_round_trip_of_many_sizes():
    rng = random.Random(2)
    for n in (64, 8192, 8256, 255 * 255, 64 * 4000, 8192 * 9):
        payload = rng.randbytes(n)
        media = ogg.read(ogg.store(payload))
        assert ogg.restore(media) == payload
        assert media.bad_checksums == media.lost_packets == 0 and media.streams[1].ended
        assert media.streams[1].times()[-1] == n / ogg.RATE


def test_packets_over_pages_and_exact_lacing():
    rng = random.Random(3)
    packets = [(rng.randbytes(n), k) for k, n in enumerate((3, 0, 255, 510, 255 * 255, 255 * 255 - 1, 200_000, 1))]
    media = ogg.read(b"".join(ogg.write_stream(packets, 7)))
    assert media.streams[7].packets == [p for p, _ in packets]
    assert media.streams[7].granules[-1] == len(packets) - 1


def test_damage_is_counted_and_skipped():
    payload = bytes(range(256)) * 1200
    data = bytearray(ogg.store(payload))
    data[100_000] ^= 1
    media = ogg.read(bytes(data))
    assert media.bad_checksums >= 1 and media.lost_packets >= 1
    assert ogg.read(b"junk" + ogg.store(payload[:64])).streams[1].packets[1] == payload[:64]
    assert ogg.read(b"").streams == {} and ogg.read(b"OggS").streams == {}


def test_features_of_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (1, "a"), (4, "é" * 50_000)], "doc_id long, text string")
    rows = sorted(ogg.media_features(docs.selectExpr("doc_id", "text", "text as feature")).collect())
    assert [(r.n_bytes, r.payload_bytes) for r in rows] == [(1, 64), (1, 64), (0, 64), (0, 64), (100_000, 100_032)]
    assert rows[0] == rows[1] and rows[2][1:] == rows[3][1:]
    assert ogg.media_features(docs.limit(0)).count() == 0


def test_packet_table(spark):
    df = spark.createDataFrame([(5, bytearray(ogg.store(b"x" * 64))), (6, None)], "id long, media binary")
    rows = sorted(ogg.packet_table(df, "id", "media").collect())
    assert [(r.key, r.serial, r.packet) for r in rows] == [(5, 1, 0), (5, 1, 1), (5, 2, 0), (5, 2, 1)]
    assert rows[1].bytes == b"x" * 64 and rows[1].seconds == 64 / ogg.RATE


def test_every_packet_has_a_time():
    """Packets before the last of a page are timed by the samples they hold; Opus by its frames."""
    payload = random.Random(4).randbytes(8192 * 20 + 64)
    s = ogg.read(ogg.store(payload)).streams[1]
    upto, want = 0, []
    for p in s.packets[1:]:
        upto += len(p)
        want.append(upto / ogg.RATE)
    assert s.times() == [0.0, *want] and s.granules.count(-1) > 5
    head = b"OpusHead" + bytes([1, 1]) + (312).to_bytes(2, "little") + bytes(7)
    packets = [(head, 0), (b"OpusTags", 0), (bytes([0b01100000, 1]), 480), (bytes([0b11111001, 2]), 2400), (bytes([0b00011011, 3, 3]), 11040)]
    pages = ogg.write_stream(packets, 5)
    s = ogg.read(b"".join(pages)).streams[5]
    assert s.lengths() == [0, 0, 480, 1920, 8640] and s.ends()[2:] == [480, 2400, 11040]
    assert s.times()[2:] == [(g - 312) / 48000 for g in (480, 2400, 11040)]
    lone = ogg.read(b"".join(ogg.write_stream([(b"\x01vorbis" + bytes(30), 0), (b"a", 5), (b"b", 9)], 6))).streams[6]
    assert lone.ends()[1:] == [None, 9]
