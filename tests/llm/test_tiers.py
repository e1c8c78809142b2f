import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import tiers

KIND = "doc_id long, text string, ids string, tier string"


@pytest.fixture(scope="module")
def encoder():
    return tiers.Encoder(*tiers.default_tokenizer())


def test_same_ids_on_every_code_point(encoder):
    # The planes that hold assigned characters.
    points = [c for c in (*range(0x20000), *range(0x2FA00, 0x2FA20), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 2000):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}.{chr(c)}  {chr(c)}\n" for c in points[at : at + 2000])
        assert encoder.ids(text)[:-1].tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_same_ids_on_odd_texts(encoder):
    texts = ["", " ", "a<|endoftext|>b", "<|endoftext|", " " * 400_000, "\n" * 400_000 + "x", "x" * 100_000, "\x00 ", "é"]
    for t in texts:
        assert encoder.ids(t).tolist() == [*encoder.library.encode(t, add_special_tokens=False).ids, tiers.END]


@pytest.mark.parametrize("windows", [(4, 8, 16, 32), (256, 512, 1024, 2048), (8,), (1, 32), (4, 32)])
def test_all_windows_are_full(windows):
    r = random.Random(str(windows))
    for most in (1, windows[0], windows[-1]):
        for n in (0, 1, 5, 300):
            pool, want = tiers.Pool(), set()
            for d in range(n):
                size = r.randint(1, most)
                pool.add(tiers.Piece(d, 0, np.arange(size, dtype="<u4"), size))
                want |= {(d, i) for i in range(size)}
            got = []
            for size, window in tiers.pack_tiers(pool, windows):
                assert size in windows and sum(len(p.ids) for p in window) == size
                got += [(p.doc, i) for p in window for i in p.ids.tolist()]
                assert all(p.ids[0] == p.start for p in window)
            rest = [(p.doc, i) for ps in pool.by.values() for p in ps for i in p.ids.tolist()]
            assert len(rest) < windows[0] and len(got) + len(rest) == len(want) and set(got) | set(rest) == want


def test_long_gaps_take_short_documents_whole():
    pool = tiers.Pool()
    for d, n in enumerate([1500, 540, 8, 300, 200, 12]):
        pool.add(tiers.Piece(d, 0, np.zeros(n, "<u4"), n))
    (size, first), (other, second) = tiers.pack_tiers(pool, tiers.WINDOWS)
    # Nothing is cut but the last document that a gap has no whole filler for.
    assert size == 2048 and [(p.doc, len(p.ids)) for p in first] == [(0, 1500), (1, 540), (2, 8)]
    assert other == 512 and [(p.doc, len(p.ids)) for p in second] == [(3, 300), (4, 200), (5, 12)]


def test_deal_is_even():
    r = random.Random(5)
    for n, groups in ((1, 1), (7, 3), (512, 16), (500, 16)):
        costs = [r.randint(1, 1000) for _ in range(n)]
        chosen = tiers.deal(costs, groups)
        counts = np.bincount(chosen, minlength=groups)
        sums = np.bincount(chosen, costs, minlength=groups)
        assert counts.max() - counts.min() <= 1
        assert n < 100 or sums.max() - sums.min() <= 2 * max(costs)


def check(rows, docs, encoder):
    """Every id lies in one piece, pieces are gapless in windows; returns the padding."""
    left = {}
    for d, t in docs:
        left.setdefault(d, []).append(encoder.ids(t or ""))
    spans, windows = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier, r.step_group))
    assert set(spans) == set(left)
    for d, texts in left.items():
        ids = texts[0]
        assert all(t.tolist() == ids.tolist() for t in texts)
        starts = sorted(spans[d])
        cover = np.zeros(len(ids) + 1, int)
        for start, n, crc, total in starts:
            assert total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes()) and n > 0
            cover[start] += 1
            cover[start + n] -= 1
        assert (np.cumsum(cover)[:-1] == len(texts)).all()
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, n, _, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and len({p[2:] for p in parts}) == 1 and at <= parts[0][2]
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert at == parts[0][2] or parts[0][2] == 2048
    return padding


def test_pack(spark, encoder):
    r = random.Random(3)
    words = ["one", " two", " three", "\n", " Zwölf", " 東京", " 42"]
    texts = ["".join(r.choice(words) for _ in range(r.choice([0, 1, 30, 200, 900, 1500, 5000]))) for _ in range(300)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, None, "x", "y"), (1000, "", None, None), (7, texts[7], "x", "y"), (7, texts[7], "x", "y")]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = tiers.pack(df, tiers.default_tokenizer())
    assert got.columns == ["doc_id", *tiers.FIELDS]
    pieces = got.select("*", F.crc32("ids").alias("ids_crc32")).collect()
    padding = check(pieces, [(x[0], x[1]) for x in rows], encoder)
    # One window stays short, at most.
    assert padding < 2048 and len({p.tier for p in pieces}) > 1
    steps = {}
    for p in pieces:
        steps.setdefault(p.step_group, {}).setdefault(p.sequence_id, p.tier)
    assert all(len(set(s.values())) == 1 and sum(s.values()) <= tiers.STEP_TOKENS for s in steps.values())

    whole = {s.sequence_id: s for s in tiers.sequences(got).collect()}
    for p in pieces:
        row = whole[p.sequence_id]
        assert bytes(row.ids)[4 * p.offset : 4 * (p.offset + p.length)] == bytes(p.ids)
        assert p.offset in row.cu_seqlens and p.offset + p.length in row.cu_seqlens and p.doc_id in row.documents
    assert all(len(s.ids) == 4 * s.n_tokens == 4 * s.cu_seqlens[-1] for s in whole.values())


def test_batches_are_bounded_by_bytes():
    full = [(i, 0, 2048, bytes(8192), 2048, i, 0, 2048, 0) for i in range(1000)]
    short = [(i, 0, 1, bytes(4), 1, i, 0, 2048, 0) for i in range(20_000)]
    long = [(0, 0, 1, bytes(2 * tiers.BYTES), 1, 0, 0, 2048, 0)]
    for rows in ([], full, short, long, full + long + short):
        parts = list(tiers._slices(rows))
        assert [r for part in parts for r in part] == rows and all(parts)
        assert all(len(part) == 1 or sum(len(r[3]) for r in part) <= tiers.BYTES for part in parts)
        assert all(len(part) <= tiers.ROWS for part in parts)


def test_odd_tables(spark, encoder):
    df = spark.createDataFrame([(None, None, None, None)], KIND)
    (row,) = tiers.pack(df, tiers.default_tokenizer()).collect()
    assert (row.doc_id, row.start, row.length, row.doc_tokens, row.offset, row.tier) == (None, 0, 1, 1, 0, 2048)
    assert tiers.pack(df.limit(0), tiers.default_tokenizer()).count() == 0
    named = df.select(F.lit("k").alias("id"), F.lit("a b").alias("text"))
    assert tiers.pack(named, tiers.default_tokenizer(), id_column="id").first().id == "k"
    with pytest.raises(ValueError):
        tiers.pack(df, tiers.default_tokenizer(), windows=(8, 4))


def test_query(spark, encoder):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert check(tiers.op13_tiers(spark, folder).collect(), docs, encoder) < 2048
