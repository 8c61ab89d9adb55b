"""Functions on binary columns: CRC-32/MPEG-2 and the head of media tags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_POLYNOMIAL = 0x04C11DB7


def _table() -> np.ndarray:
    """What each byte in front does to the checksum."""
    x = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        x = (x << np.uint32(1)) ^ np.where(x >> np.uint32(31), np.uint32(_POLYNOMIAL), np.uint32(0))
    return x


def crc32_mpeg2_of(blobs: list[bytes]) -> np.ndarray:
    """Checksums of all blobs at once: a step takes the next byte of each blob that has one.  Bits aren't reflected, nothing is inverted at the end."""
    table = _table()
    length = np.fromiter(map(len, blobs), np.int64, len(blobs))
    data = np.frombuffer(b"".join(blobs), np.uint8)
    start = np.cumsum(length) - length
    # the longest first, so that those that have a byte left are a prefix
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
    crc = np.full(len(blobs), 0xFFFFFFFF, np.uint32)
    first = start[order]
    for k, n in enumerate(live.tolist()):
        part = crc[:n]
        crc[:n] = (part << np.uint32(8)) ^ table[(part >> np.uint32(24)) ^ data[first[:n] + k]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


@F.pandas_udf(LongType())
def _crc32_mpeg2(blobs: pd.Series) -> pd.Series:
    known = blobs.notna()
    out = pd.Series([None] * len(blobs), dtype="Int64")
    out[known.to_numpy()] = crc32_mpeg2_of(blobs[known].tolist()).astype(np.int64)
    return out


def crc32_mpeg2(blob: Column) -> Column:
    """CRC-32/MPEG-2 of a binary column, as an unsigned number; null of null.  Built-in CRC-32 is the reflected form."""
    return _crc32_mpeg2(blob)


def _byte(blob: Column, at: Column | int) -> Column:
    """The byte at a place from 0 on; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(at < F.octet_length(blob), F.conv(F.hex(F.substring(blob, at + 1, F.lit(1))), 16, 10).cast("int"))


# Fixed values of the format.
AUDIO, VIDEO = 8, 9
KEY_FRAME, INFO_FRAME = 1, 5
VIDEO_PACKETS = {"sequence_start": 0, "coded": 1, "sequence_end": 2, "coded_x": 3, "multitrack": 6, "modex": 7}
AUDIO_PACKETS = {"sequence_start": 0, "sequence_end": 2, "multitrack": 5, "modex": 7}
VIDEO_CODECS = {2: "sorenson_h263", 3: "screen_video", 4: "on2_vp6", 5: "on2_vp6_alpha", 7: "avc", 12: "hevc"}
AUDIO_CODECS = {0: "pcm", 1: "adpcm", 2: "mp3", 3: "pcm_le", 4: "nellymoser_16khz_mono", 5: "nellymoser_8khz_mono", 6: "nellymoser", 7: "g711_alaw", 8: "g711_mulaw", 10: "aac", 11: "speex", 14: "mp3_8k", 15: "device_specific"}
VIDEO_CODES = {"avc1": "avc", "hvc1": "hevc", "vp08": "vp8", "vp09": "vp9", "av01": "av1"}
AUDIO_CODES = {"ac-3": "ac3", "eac-": "eac3", "eac3": "eac3", "Opus": "opus", ".mp3": "mp3", "fLaC": "flac", "mp4a": "aac", "aac\0": "aac"}
#: Codecs whose second byte is the packet's kind.
_PACKETIZED = (7, 12)
_EX_AUDIO, _AAC = 9, 10


def _named(value: Column, names: dict) -> Column:
    return F.coalesce(*[F.when(value == v, F.lit(name)) for v, name in names.items()])


def _packet(body: Column, packets: dict[str, int]) -> tuple[Column, Column]:
    """(kind, place of the codec's four characters) of an extended header; nulls where bytes lack.

    ModEx fields come first, any number of them: a size (a byte, or 16 bits more if that is 255; one more byte follows
    than it says), data, and a byte whose low half is the next kind.  Several tracks have a byte with the packets' kind.
    """
    modex, first = packets["modex"], _byte(body, 0).bitwiseAND(15)
    start = F.struct(first.alias("kind"), F.lit(1).alias("at"))

    def next_field(acc: Column, _: Column) -> Column:
        short = _byte(body, acc["at"]) + 1
        wide = _byte(body, acc["at"] + 1) * 256 + _byte(body, acc["at"] + 2) + 1
        after = acc["at"] + F.when(short == 256, wide + 3).otherwise(short + 1)
        found = F.struct(_byte(body, after).bitwiseAND(15).alias("kind"), (after + 1).alias("at"))
        return F.when(acc["kind"] == modex, found).otherwise(acc)

    # a field has three bytes at least
    fields = F.aggregate(F.sequence(F.lit(0), F.floor(F.octet_length(body) / 3).cast("int")), start, next_field)
    head = F.when(first == modex, fields).otherwise(start)
    kind, at = head["kind"], head["at"]
    many = kind == packets["multitrack"]
    inner = F.when(many, _byte(body, at).bitwiseAND(15)).otherwise(kind)
    return F.when(~many | (inner != packets["multitrack"]), inner), F.when(many, at + 1).otherwise(at)


def tag_class(kind: Column, body: Column) -> Column:
    """A struct of what a media tag is, from its kind (8 audio, 9 video; others have no class) and its body.

    ``keyframe``, ``keyframe_media`` (one with pictures), ``sequence_header``, ``end_of_sequence``, ``enhanced`` and
    ``codec`` (null if unknown).  Null or empty bodies and headers that end too early have no class beyond what their
    first byte says.
    """
    first, second = _byte(body, 0), _byte(body, 1)
    frame, low, sound = F.shiftright(first, 4).bitwiseAND(7), first.bitwiseAND(15), F.shiftright(first, 4)
    video, audio = (kind == VIDEO) & first.isNotNull(), (kind == AUDIO) & first.isNotNull()
    enhanced = (video & (first >= 128)) | (audio & (sound == _EX_AUDIO))
    info = video & (frame == INFO_FRAME)
    (v_packet, v_at), (a_packet, a_at) = _packet(body, VIDEO_PACKETS), _packet(body, AUDIO_PACKETS)
    code = lambda at: F.when(at + 4 <= F.octet_length(body), F.substring(body, at + 1, F.lit(4)).cast("string"))
    v_code, a_code = code(v_at), code(a_at)
    key = video & (frame == KEY_FRAME)
    packetized = video & low.isin(*_PACKETIZED)
    old_codec = _named(low, VIDEO_CODECS)
    coded = v_packet.isin(VIDEO_PACKETS["coded"], VIDEO_PACKETS["coded_x"]) & v_code.isNotNull()
    media = F.when(enhanced, coded).when(packetized, second == 1).otherwise(old_codec.isNotNull() & second.isNotNull())
    starts = F.when(video & enhanced, v_packet == VIDEO_PACKETS["sequence_start"]).when(packetized, second == 0).when(audio & enhanced, a_packet == AUDIO_PACKETS["sequence_start"]).when(audio & (sound == _AAC), second == 0)
    ends = F.when(video & enhanced, v_packet == VIDEO_PACKETS["sequence_end"]).when(packetized, second == 2).when(audio & enhanced, a_packet == AUDIO_PACKETS["sequence_end"])
    codec = F.when(video & enhanced & v_packet.isNotNull(), _named(v_code, VIDEO_CODES)).when(video & ~enhanced, old_codec).when(audio & enhanced & a_packet.isNotNull(), _named(a_code, AUDIO_CODES)).when(audio & ~enhanced, _named(sound, AUDIO_CODECS))
    true = lambda c: F.coalesce(c & ~info, F.lit(False))
    return F.struct(
        true(key).alias("keyframe"),
        true(key & media).alias("keyframe_media"),
        true(starts).alias("sequence_header"),
        true(ends).alias("end_of_sequence"),
        F.coalesce(enhanced, F.lit(False)).alias("enhanced"),
        F.when(~F.coalesce(info, F.lit(False)), codec).alias("codec"),
    )
