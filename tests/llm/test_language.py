import zlib
from collections import Counter

import duckdb
import pytest

from tidewatch.llm import language as g

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        p = f" {w} "
        out.update(w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def ranked(counts, size):
    return [x for x, _ in sorted(((code(k), n) for k, n in counts.items()), key=lambda p: (-p[1], p[0]))[:size]]


@pytest.fixture(scope="module")
def rows():
    sql = f"select doc_id, text, lang from read_parquet('{SF}/documents.parquet')"
    return duckdb.connect().execute(sql).fetchall()


def test_against_plain_version(spark, rows):
    size = 60
    odd = [(None, "Ñandú!", "es"), (-1, None, "en"), (-2, "", "en"), (-3, "12 34 !?", "en"), (-4, "the of", None)]
    some = rows[:300] + odd + [rows[0]] * 2
    df = spark.createDataFrame([(*r, "x") for r in some], "doc_id long, text string, lang string, score string")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    totals = {}
    for i, t, lang in some:
        if t is not None and lang is not None and not held(i):
            totals.setdefault(lang, Counter()).update(plain_grams(t))
    profiles = {k: {c: p for p, c in enumerate(ranked(v, size))} for k, v in totals.items()}
    want = []
    for i, t, _ in some:
        mine = ranked(plain_grams(t or ""), size)
        if not mine:
            want.append((i, held(i), "und", 0.0))
            continue
        far = {k: sum(min(size, abs(p[c] - j)) if c in p else size for j, c in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want.append((i, held(i), best, 1 - far[best] / (size * len(mine))))
    learned = g.learn(g.split(df).where("not held_out"), size=size)
    got = g.identify(g.split(df), learned, size=size).select("doc_id", "held_out", "lang_pred", "score")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_held_out_accuracy(spark, rows):
    got = {r.doc_id: r for r in g.op6_language(spark, SF).collect()}
    assert len(got) == len(rows)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out and lang]
    assert len(held) > 150 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_learned(spark, rows):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[-2:] for r in g.identify(df, g.learn(df)).collect()] == [("und", 0.0)]
    assert g.identify(df.limit(0), g.learn(df)).count() == 0
