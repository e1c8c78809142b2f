import hashlib
import random

import numpy as np
import pytest

from tidewatch.llm import common, packing


def plain_bfd(sizes, length):
    rooms, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        fits = [r for r in rooms if r >= sizes[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - sizes[i])
        else:
            rooms.append(length - sizes[i])
        out[i] = sorted(rooms)
    return out, len(rooms)


@pytest.mark.parametrize("length", [1, 2, 7, 16, 100])
def test_best_fit(length):
    r = random.Random(length)
    for n in (0, 1, 5, 200):
        sizes = [r.randint(1, length) for _ in range(n)]
        places = packing.best_fit_decreasing(sizes, length)
        used = {}
        for (row, column), size in zip(places, sizes, strict=True):
            span = range(column, column + size)
            assert column + size <= length and not used.setdefault(row, set()) & set(span)
            used[row] |= set(span)
        assert len(used) == plain_bfd(sizes, length)[1]
        assert all(u == set(range(len(u))) for u in used.values())


def test_block_layout():
    docs = [("a", np.arange(1, 8)), (None, np.arange(0)), ("b", np.arange(50, 52)), ("b", np.arange(70, 71))]
    got = packing.pack_block(docs, 4, "<u2", 0)
    assert got["ids"].tolist() == [[1, 2, 3, 4], [5, 6, 7, 70], [50, 51, 0, 0]]
    assert got["lengths"].tolist() == [4, 4, 2] and got["row_ends"].tolist() == [1, 3, 4]
    assert got["cu_seqlens"].tolist() == [0, 4, 0, 3, 4, 0, 2] and got["resets"].tolist() == [0, 0, 3, 0]
    back = list(packing.unpack(got))
    assert [b[0] for b in back] == ['"a"', "null", '"b"', '"b"']
    assert [b[1].tolist() for b in back] == [d[1].tolist() for d in docs]


def test_round_trip(spark):
    enc = packing.ByteBpe(*packing.default_tokenizer())
    r = random.Random(2)
    texts = [" ".join(r.choice(["one", "two", "three", "x"]) for _ in range(r.choice([0, 1, 9, 40, 3000]))) for _ in range(120)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "y"), (4, texts[4], "x"), (900, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = common.scratch(spark, "packed-test")
    packing.write(df, path, packing.default_tokenizer(), length=64, block_tokens=20_000)
    want = [(str(i) if i is not None else "null", hashlib.sha256(enc.ids(t or "").astype("<u4").tobytes()).hexdigest()) for i, t, _ in rows]
    got = packing.read(spark, path).collect()
    assert sorted((g.doc_id, g.ids_sha256) for g in got) == sorted(want)
    texts_back = {g.doc_id: g for g in got}
    assert enc.library.decode(enc.ids(texts[9]).tolist()) == texts[9] and texts_back["9"].n_tokens == len(enc.ids(texts[9]))
    assert len({g.file for g in got}) > 3 and all(g.n_pieces == -(-g.n_tokens // 64) for g in got)
    path = common.scratch(spark, "packed-test")
    packing.write(df.limit(0), path, packing.default_tokenizer())
    assert packing.read(spark, path).count() == 0
