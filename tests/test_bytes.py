"""Functions on binary columns against bit-by-bit and byte-by-byte versions."""

import random

from pyspark.sql import functions as F

from rillwork.functions import bytes as B


def plain_crc(blob):
    crc = 0xFFFFFFFF
    for b in blob:
        for k in range(7, -1, -1):
            top = (crc >> 31) ^ (b >> k & 1)
            crc = (crc << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    return crc


def test_crc32_mpeg2(spark):
    rng = random.Random(1)
    blobs = [b"", b"\x00", b"123456789", *(rng.randbytes(rng.randrange(400)) for _ in range(200)), rng.randbytes(100_000)]
    assert B.crc32_mpeg2_of(blobs).tolist() == [plain_crc(b) for b in blobs]
    assert plain_crc(b"123456789") == 0x0376E6E7
    assert B.crc32_mpeg2_of([]).tolist() == []
    frame = spark.createDataFrame([(i, b) for i, b in enumerate([*blobs[:50], None])], "i int, b binary")
    got = {r["i"]: r["crc"] for r in frame.select("i", B.crc32_mpeg2(F.col("b")).alias("crc")).collect()}
    assert got == {i: plain_crc(b) for i, b in enumerate(blobs[:50])} | {50: None}
    assert frame.limit(0).select(B.crc32_mpeg2(F.col("b"))).count() == 0


def plain_packet(data, packets):
    """(kind, four characters) of an extended header, None if it ends early."""
    data = list(data)
    kind, at = data[0] & 15, 1
    try:
        while kind == packets["modex"]:
            size, at = data[at] + 1, at + 1
            if size == 256:
                size, at = data[at] * 256 + data[at + 1] + 1, at + 2
            at += size
            kind, at = data[at] & 15, at + 1
        if kind == packets["multitrack"]:
            kind, at = data[at] & 15, at + 1
            if kind == packets["multitrack"]:
                return None
    except IndexError:
        return None
    return kind, bytes(data[at : at + 4]) if at + 4 <= len(data) else None


def plain_class(tag, data):
    none = (False, False, False, False, False, None)
    if not data or tag not in (8, 9):
        return none
    first, second = data[0], data[1] if len(data) > 1 else None
    if tag == 9:
        frame, key = first >> 4 & 7, first >> 4 & 7 == 1
        if frame == 5:
            return (False, False, False, False, first >= 128, None)
        if first >= 128:
            found = plain_packet(data, B.VIDEO_PACKETS)
            if found is None:
                return (key, False, False, False, True, None)
            kind, code = found
            return (key, key and kind in (1, 3) and code is not None, kind == 0, kind == 2, True, B.VIDEO_CODES.get(code.decode("latin-1")) if code else None)
        low = first & 15
        codec = B.VIDEO_CODECS.get(low)
        if low in (7, 12):
            return (key, key and second == 1, second == 0, second == 2, False, codec)
        return (key, key and codec is not None and second is not None, False, False, False, codec)
    sound = first >> 4
    if sound == 9:
        found = plain_packet(data, B.AUDIO_PACKETS)
        if found is None:
            return (False, False, False, False, True, None)
        return (False, False, found[0] == 0, found[0] == 2, True, B.AUDIO_CODES.get(found[1].decode("latin-1")) if found[1] else None)
    return (False, False, sound == 10 and second == 0, False, False, B.AUDIO_CODECS.get(sound))


def heads(rng, n):
    codes = [*map(str.encode, [*B.VIDEO_CODES, *B.AUDIO_CODES]), b"\xff\xfe\x00a", b""]
    for _ in range(n):
        tag = rng.choice([8, 9, 9, 18, None])
        modex = b"".join(bytes([rng.choice([0, 1, 5])]) for _ in range(0))
        parts = []
        for _ in range(rng.choice([0, 0, 0, 1, 2, 6])):
            size = rng.choice([1, 2, 7, 256, 300])
            parts.append((bytes([size - 1]) if size < 256 else b"\xff" + (size - 1).to_bytes(2, "big")) + rng.randbytes(size))
        last = rng.choice([0, 1, 2, 3, 4, 5, 6])
        top = rng.choice([0x80, 0x90, 0xA0, 0xD0, 0x10, 0x50, 0x20]) if tag == 9 else rng.choice([0x90, 0xA0, rng.randrange(16) << 4])
        kinds = [7] * len(parts) + [last]
        body = bytes([top | kinds[0]]) + b"".join(p + bytes([rng.choice([0, 0x30]) | k]) for p, k in zip(parts, kinds[1:], strict=True)) + modex
        if last in (5, 6):
            body += bytes([rng.choice([0, 0x10, 0x20]) | rng.choice([0, 1, 2, 3, 5, 6])])
        body += rng.choice(codes) + rng.randbytes(rng.randrange(4))
        yield tag, rng.choice([body, body, body, body[: rng.randrange(len(body) + 1)], rng.randbytes(rng.randrange(6))])


def test_tag_class(spark):
    rows = [(i, t, b) for i, (t, b) in enumerate([(9, None), (9, b""), (None, b"\x17\x01"), *heads(random.Random(3), 3000)])]
    frame = spark.createDataFrame(rows, "i int, t int, b binary")
    got = {r["i"]: tuple(r["c"]) for r in frame.select("i", B.tag_class(F.col("t"), F.col("b")).alias("c")).collect()}
    wrong = [(rows[i], plain_class(rows[i][1], rows[i][2]), c) for i, c in got.items() if c != plain_class(rows[i][1], rows[i][2])]
    assert not wrong, wrong[:3]
    assert len({c for c in got.values()}) > 25
