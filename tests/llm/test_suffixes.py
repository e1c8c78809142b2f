import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import suffixes as s


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p : p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        left = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def cases(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (6, 9, 12, 20, 40)]
    rows = []
    for i in range(120):
        parts = [text(r.randint(0, 12))]
        for _ in range(r.randint(0, 3)):
            whole = r.choice(shared)
            a = r.randint(0, len(whole) // 3)
            parts += [whole[a : len(whole) - r.randint(0, 9)], text(r.randint(0, 8))]
        rows.append((i, r.choice(["", " "]).join(parts)))
    rows += [(200, "ab" * 300), (201, "x" * 500), (202, ""), (203, None), (None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(205, text(2000)), (206, "y" * 39), (207, "y" * 40), (208, "y" * 41)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    length = 40
    rows = cases(seed)
    want = brute(rows, length)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n long, h string")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = s.cut_repeats(df, length=length, batches=seed + 2, kept=False).select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(x[2] > 0 for x in want) > 60 and sum(x[3] > 1 for x in want) > 5
    monkeypatch.setattr(s, "RUN", 2)
    monkeypatch.setattr(s, "STRINGS", 50)
    monkeypatch.setattr(s, "CHUNK", 600)
    monkeypatch.setattr(s, "HELD", 100)
    got = s.cut_repeats(df, length=length, batches=1).select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_levels_merge_like_a_counter(spark):
    rows = spark.createDataFrame([(i, "abc" * i) for i in range(60)], "doc_id long, text string")
    keyed = s.with_key(rows, "doc_id", "text")
    index = s.SuffixIndex(spark, 3)
    ranks = []
    for _ in range(6):
        index.add(s.contexts(keyed, 40))
        ranks.append([rank for rank, _ in index.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1]]
    one, two = (spark.table(name) for _, name in index.levels)
    plan = one.hint("merge").join(two, ["head", "h"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()


def test_a_carry_is_one_write(spark):
    """A batch that takes several levels along writes them once, and its scan leaves a file for each bucket at most."""
    rows = spark.createDataFrame([(i, "abc" * i) for i in range(60)], "doc_id long, text string")
    keyed = s.with_key(rows, "doc_id", "text")
    index = s.SuffixIndex(spark, 3)
    for _ in range(4):
        index.add(s.contexts(keyed, 40))
    assert index.made == 6 and [rank for rank, _ in index.levels] == [2]
    assert all(len(found.inputFiles()) <= 3 for found in index.shared)
    total = spark.table(index.levels[0][1]).agg(F.sum("n")).first()[0]
    assert total == 4 * s.contexts(keyed, 40).agg(F.sum("n")).first()[0]
    index.drop()


def test_empty_and_whole_characters(spark):
    df = spark.createDataFrame([(1, "é" * 300, "a"), (2, "é" * 300, "b")], "doc_id long, text string, kept string")
    assert s.cut_repeats(df.limit(0), length=41).count() == 0
    for r in s.cut_repeats(df, length=41, characters=True).select("doc_id", "n_removed", "n_spans").collect():
        assert r.n_removed == 600 and r.n_spans == 1
    raw = "aéb".encode()
    assert s.whole_characters(raw, [(0, 2), (2, 4)]) == [(0, 1), (3, 4)]
