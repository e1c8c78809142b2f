"""Media columns: MPEG audio streams that carry bytes, their parser, and a query over documents.

A stream is an ID3v2.4 tag (it holds the payload's length), a frame with the variable-bitrate table,
and Layer III frames of silence whose ancillary data, behind an empty side information, is the
payload; the last frame takes the smallest bitrate that holds the rest. The parser
takes any MPEG-1/2/2.5 stream of layers I to III: it skips tags, finds frames again after damage,
checks the CRC of protected Layer III frames (those of layers I and II are counted as unchecked) and gives exact sample counts and frame offsets. Free-format
frames (bitrate 0) have no length of their own and are skipped like damage.

Rows are independent: one narrow Arrow pass, no shuffle. Null text is the empty text (a payload of 64
zero bytes), a null id stays null, repeated rows give repeated rows, other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index 1..14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

UNIT = 64
# Of the written frames: header, CRC and the side information of one channel.
HEAD = 4 + 2 + 17


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    crc: bool
    kbps: int
    rate: int
    padding: int
    mono: bool

    @property
    def samples(self) -> int:
        if self.layer == 1:
            return 384
        return 1152 if self.layer == 2 or self.version == 1.0 else 576

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12 * self.kbps * 1000 // self.rate + self.padding) * 4
        return self.samples // 8 * self.kbps * 1000 // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.version == 1.0:
            return 17 if self.mono else 32
        return 9 if self.mono else 17

    def follows(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or bitrate in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbps = BITRATES[1 if version == 1.0 else 2, layer][bitrate - 1]
    return Header(version, layer, not four[1] & 1, kbps, RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6 == 3)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Stream:
    """What the parser found."""

    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    kbps: set = field(default_factory=set)
    checked: int = 0
    unchecked: int = 0
    bad_crc: int = 0
    skipped: int = 0
    resyncs: int = 0
    tags: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    payload: bytes = b""


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _safe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def _id3(data: bytes, at: int) -> tuple[int, dict]:
    """End of the ID3v2 tag at ``at`` and its text frames."""
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end, tags, p = at + 10 + size, {}, at + 10
    if flags & 0x40 and p + 4 <= end:
        p += _syncsafe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    while major in (3, 4) and p + 10 <= min(end, len(data)) and data[p] != 0:
        n = _syncsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        name, body = data[p : p + 4], data[p + 10 : p + 10 + n]
        if name[:1] == b"T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            key, _, value = body[1:].decode(code, "replace").partition("\0")
            if name == b"TXXX":
                tags[key] = value.rstrip("\0")
            else:
                tags[name.decode("latin-1")] = key
        p += 10 + n
    return end + (10 if flags & 0x10 else 0), tags


def _table(body: bytes, h: Header) -> dict:
    """The variable-bitrate table in a first frame: Xing/Info or VBRI."""
    for at in (4 + h.side, 6 + h.side):
        if body[at : at + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(body[at + 4 : at + 8], "big"), at + 8
            out = {"kind": body[at : at + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(body[p : p + 4], "big"), p + 4
            if flags & 4:
                out["toc"] = list(body[p : p + 100])
            return out
    if body[36:40] == b"VBRI":
        size, frames = struct.unpack(">II", body[46:54])
        return {"kind": "VBRI", "bytes": size, "frames": frames}
    return {}


def parse(data: bytes) -> Stream:
    """Frames, tags, tables and checks of a stream; damage is skipped and counted."""
    out, at, first, last, parts = Stream(), 0, True, None, []
    end = len(data)
    # Where an ID3v1 tag may be: payload can have the same bytes, so a sure frame over that place comes first.
    old = end - 128 if data[-128:-125] == b"TAG" else end
    while at < end:
        if at == old:
            out.tags["id3v1"] = data[-125:-95].decode("latin-1").rstrip("\0 ")
            break
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at, tags = _id3(data, at)
            out.tags |= tags
            continue
        h = header(data[at : at + 4])
        if h is not None:
            then = at + h.length
            # A frame counts if it is whole and another frame, a tag or the end comes behind it.
            after = header(data[then : then + 4])
            sure = then in (old, end) or data[then : then + 3] == b"ID3" or (after is not None and after.follows(h))
            if then > end or not (sure or last is not None and h.follows(last) and not at < old < then):
                h = None
        if h is None:
            nearest = data.find(b"\xff", at + 1, end)
            tag = data.find(b"ID3", at + 1, end if nearest < 0 else nearest)
            then = min((x for x in (nearest, tag, old) if x > at), default=end)
            out.skipped += then - at
            out.resyncs += last is not None or not out.resyncs
            at, last = then, None
            continue
        body = data[at:then]
        if h.crc:
            if h.layer != 3:
                out.unchecked += 1
            else:
                out.checked += 1
                out.bad_crc += crc16(body[2:4] + body[6 : 6 + h.side]) != int.from_bytes(body[4:6], "big")
        table = _table(body, h) if first and h.layer == 3 else {}
        if table:
            out.table = table
        else:
            out.offsets.append(at)
            out.samples += h.samples
            out.kbps.add(h.kbps)
            out.rate = h.rate
            parts.append(body[4 + 2 * h.crc + h.side * (h.layer == 3) :])
        first, last, at = False, h, then
    kept = out.tags.get("payload_bytes", "")
    whole = b"".join(parts)
    out.payload = whole[: int(kept)] if kept.isdigit() else whole
    return out


KBPS = BITRATES[1, 3]
# MPEG-1 Layer III at 32 kHz, one channel: 4.5 bytes for each kbit/s.
LENGTHS = [144 * k // 32 for k in KBPS]


@lru_cache(32)
def _frame_head(index: int) -> bytes:
    four = bytes((0xFF, 0xFA, index + 1 << 4 | 2 << 2, 3 << 6))
    side = bytes(17)
    return four + crc16(four[2:] + side).to_bytes(2, "big") + side


def write(payload: bytes) -> bytes:
    """A stream that carries ``payload``."""
    body = b"\x03payload_bytes\0" + str(len(payload)).encode()
    frames = b"TXXX" + _safe(len(body)) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + _safe(len(frames)) + frames
    top = len(KBPS) - 1
    room = LENGTHS[top] - HEAD
    full, rest = divmod(len(payload), room)
    head, parts = _frame_head(top), []
    for at in range(0, full * room, room):
        parts += (head, payload[at : at + room])
    if rest:
        index = next(i for i, n in enumerate(LENGTHS) if n - HEAD >= rest)
        parts += (_frame_head(index), payload[full * room :], bytes(LENGTHS[index] - HEAD - rest))
    audio = b"".join(parts)
    count = full + bool(rest)
    size = LENGTHS[5] + len(audio)
    # Share of the bytes (of 256) before each hundredth of the time.
    toc = bytes(min(255, (LENGTHS[5] + i * count // 100 * LENGTHS[top]) * 256 // size) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, count, size) + toc
    return tag + (_frame_head(5) + xing).ljust(LENGTHS[5], b"\0") + audio


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % UNIT or UNIT * (not raw))


COLUMNS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, sample_rate int, n_samples long, frame_offsets array<long>"
)


def described(raw: bytes) -> tuple:
    """The columns of one text: written, read back, checked and described."""
    media = write(pad(raw))
    found = parse(media)
    if found.bad_crc or found.skipped or found.table["frames"] != len(found.offsets):
        raise ValueError("an MPEG stream did not come back as it was written")
    back = found.payload
    feature = (
        f"mpeg1-l3;hz={found.rate};frames={len(found.offsets)};samples={found.samples};"
        f"ms={found.samples * 1000 // found.rate};kbps={min(found.kbps)}-{max(found.kbps)};"
        f"crc_ok={found.checked - found.bad_crc}"
    )
    return (
        len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, found.rate, found.samples, found.offsets,
    )


def mpeg_columns(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id and what its text is as an MPEG stream (``COLUMNS``)."""
    kind = df.schema[id_column].dataType.simpleString()
    asked = df.select(F.col(id_column).alias("_id"), F.col(text).cast("binary").alias("_raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
                 "feature", "sample_rate", "n_samples", "frame_offsets"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                 pa.int32(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            rows = [described(x.as_py() or b"") for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_column, *names])

    return asked.mapInArrow(run, f"`{id_column}` {kind}, {COLUMNS}")


def op10_mpeg_audio(spark: SparkSession, folder: str) -> DataFrame:
    return mpeg_columns(common.table(spark, folder, "documents"))
