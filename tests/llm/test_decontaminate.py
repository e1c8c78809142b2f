import hashlib
import random
import re

from tidewatch.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, size):
    wins = {}
    for name, text in items:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add("null" if name is None else str(name))
    out = []
    for i, text in docs:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        hit, found = set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if names := wins.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    found |= names
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), names, bool(hit)))
    return sorted(out, key=repr)


def cases():
    r = random.Random(3)
    vocab = ["a", "ab", "Über", "x1", "foo", "bar", "é", "zz"]
    text = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 3, 5, 9]))) for i in range(25)] + [(7, "a ab foo"), (None, "zz zz"), (99, None)]
    docs = [(i, text(r.choice([0, 1, 4, 30, 200]))) for i in range(60)] + [(3, None), (None, "foo bar"), (5, "FOO Bar!")]
    docs += [(1000, text(30_000)), docs[4], docs[4]]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_hit int, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 3)
    assert sorted(map(tuple, d.mark(df, bench, size=3).collect()), key=repr) == want
    assert sum(x[5] for x in want) > 20
    monkeypatch.setattr(d, "BLOCK_WINDOWS", 5)
    monkeypatch.setattr(d, "STRETCH", 3)
    monkeypatch.setattr(d, "CHUNK", 100)
    assert sorted(map(tuple, d.mark(df, bench, size=3).collect()), key=repr) == want
    kept = d.clean(df, bench, size=3)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(x[0] or -1 for x in want if not x[5])


def test_empty(spark):
    docs, items = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert not any(r.contaminated for r in d.mark(df, bench.limit(0)).collect())
    assert d.mark(df.limit(0), bench).count() == 0


def test_group_finds_all_overlaps():
    g = d.Group([b" a a ", b" a b "])
    assert sorted(g.find(b" a a a b ")) == [(0, b" a a "), (2, b" a a "), (4, b" a b ")]
