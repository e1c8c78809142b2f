import hashlib
import zlib

import pytest

from tidewatch.llm import media


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1417, 1418, 1417 * 3, 100_001])
def test_round_trip(size):
    raw = bytes(i * 7 % 251 for i in range(size))
    payload = media.pad(raw)
    assert len(payload) % 64 == 0 and len(payload) > 0
    got = media.parse(media.write(payload))
    assert got.payload == payload
    assert got.table["frames"] == len(got.offsets) and got.samples == 1152 * len(got.offsets)
    assert not got.bad_crc and not got.skipped


def test_any_bytes_round_trip_with_false_syncs():
    payload = bytes([0xFF, 0xFA, 0xE8, 0xC0]) * 4096
    assert media.parse(media.write(payload)).payload == payload


@pytest.mark.parametrize("size", [64, 128, 1408, 1472, 2880])
def test_payload_that_looks_like_an_old_tag(size):
    for at in range(max(0, size - 1417), size - 2):
        payload = bytearray(b"." * size)
        payload[at : at + 3] = b"TAG"
        got = media.parse(media.write(bytes(payload)))
        assert got.payload == payload and not got.skipped and "id3v1" not in got.tags, at
        got = media.parse(media.write(bytes(payload)) + b"TAG" + b"title".ljust(125, b"\0"))
        assert got.payload == payload and not got.skipped and got.tags["id3v1"] == "title", at
    assert media.described(b"x" * 29 + b"TAG" + b"x" * 60)[1] == 128


def test_old_tag_behind_a_cut_frame():
    whole, tag = media.write(bytes(64) * 200), b"TAG" + b"title".ljust(125, b"\0")
    for cut in (1, 60, 127):
        got = media.parse(whole[:-cut] + tag)
        assert len(got.offsets) == len(media.parse(whole).offsets) - 1 and got.tags["id3v1"] == "title", cut


def test_damage_is_skipped_and_counted():
    whole = media.write(bytes(64) * 200)
    good = media.parse(whole)
    second = good.offsets[1]
    got = media.parse(whole[:second] + b"junk \xff\xfa noise" + whole[second:])
    assert got.offsets[0] == good.offsets[0] and len(got.offsets) == len(good.offsets)
    assert got.skipped == 13 and got.resyncs == 1
    broken = bytearray(whole)
    broken[second + 5] ^= 1
    assert media.parse(bytes(broken)).bad_crc == 1
    assert len(media.parse(whole[:-3]).offsets) == len(good.offsets) - 1


def test_other_layers_and_old_tags():
    # MPEG-1 layer II, 32 kbit/s, 48 kHz: 96 bytes; MPEG-2 layer III, 8 kbit/s, 22.05 kHz: 26 bytes.
    two = bytes((0xFF, 0xFD, 0x14, 0xC4)).ljust(96, b"\0")
    got = media.parse(two * 5 + b"TAG" + b"title".ljust(125, b"\0"))
    assert (len(got.offsets), got.samples, got.rate) == (5, 5 * 1152, 48000) and got.tags["id3v1"] == "title"
    low = bytes((0xFF, 0xF3, 0x10, 0xC4)).ljust(26, b"\0")
    got = media.parse(low * 4)
    assert (len(got.offsets), got.samples, got.rate) == (4, 4 * 576, 22050)


def test_protected_frames_of_other_layers_count_as_unchecked():
    two = bytes((0xFF, 0xFC, 0x14, 0xC4)).ljust(96, b"\0")
    got = media.parse(two * 5)
    assert (len(got.offsets), got.checked, got.unchecked, got.bad_crc) == (5, 0, 5, 0)


def test_rows(spark):
    rows = [(1, "Grüße", "x"), (None, None, "y"), (3, "", "z"), (3, "", "z"), (5, "a" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    got = sorted(media.mpeg_columns(df).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    assert [(r.doc_id, r.n_bytes, r.payload_bytes) for r in got] == [
        (None, 0, 64), (1, 7, 64), (3, 0, 64), (3, 0, 64), (5, 200_000, 200_000),
    ]
    raw = "Grüße".encode().ljust(64, b"\0")
    assert got[1].payload_sha256 == hashlib.sha256(raw).hexdigest() and got[1].tail_crc32 == zlib.crc32(raw)
    assert media.mpeg_columns(df.limit(0)).count() == 0
