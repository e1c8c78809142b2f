import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    """item -> [(doc, score)] by counting all terms of all documents."""
    counted = [(d, terms(t)) for d, t in docs if terms(t)]
    total, length = len(counted), sum(len(t) for _, t in counted)
    merged = {}
    for i, t in items:
        merged.setdefault(i, set()).update(terms(t))
    out = {}
    for i, mine in merged.items():
        rows = []
        for d, t in counted:
            m, score = 50 + 50 * len(t) * total // length, 0
            for x in mine & set(t):
                df, tf = sum(x in u for _, u in counted), t.count(x)
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
                score += w * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                rows.append((d, score))
        if rows:
            out[i] = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0]))[:top]
    return out


def ranked(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return {i: [x[1:] for x in sorted(v)] for i, v in got.items() if [x[0] for x in sorted(v)] == list(range(1, len(v) + 1))}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(12)
    words = ["a", "B", "b1", "Ünï", "ab", "ba", "東京", "é", "É", "x" * 300, "0", "aba", "zz", "q"]
    marks = [" ", ", ", "\n", "--", "\x7f", "_", "@"]

    def text(n):
        return "".join(r.choice(words) + r.choice(marks) for _ in range(n))

    docs = [(i, text(r.choice([0, 1, 3, 20, 200])), "k") for i in range(150)]
    docs += [(i, docs[7][1], "k") for i in range(200, 230)] + [(7, docs[7][1], "k"), (None, docs[7][1], "k"), (None, "a", None)]
    docs += [(900, None, "k"), (901, "--", "k"), (902, "A" * 5000 + " a", "k"), (903, "a " * 100_000, None)]
    items = [(i, text(r.choice([1, 2, 8])), 1) for i in range(20)]
    items += [(3, "aba aba zz", 1), (None, "q a", 1), (None, "zz", 1), (50, None, 1), (51, "!", 1), (52, "nowhere", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(4)
    return docs, items, d, spark.createDataFrame(items, "item_id long, text string, score long")


@pytest.mark.parametrize("block,top", [(lexical.BLOCK_TERMS, 50), (7, 3), (1, 1)])
def test_against_plain_version(tables, block, top):
    docs, items, d, i = tables
    got = lexical.search(d, i, top=top, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked(got) == plain([x[:2] for x in docs], [x[:2] for x in items], top)


def test_sums_beyond_doubles(tables, monkeypatch):
    docs, items, d, i = tables
    monkeypatch.setattr(lexical, "EXACT", 0)
    want = plain([x[:2] for x in docs], [x[:2] for x in items], 5)
    assert ranked(lexical.search(d.coalesce(1), i, top=5)) == want


def test_automaton_finds_whole_terms_only():
    block = lexical.Block([(0, b"ab"), (0, b"b"), (1, b"ab"), (1, "é".encode())])
    texts = ["ab ab-b cab abb AB", "", "é É éé", "b"]
    n, text, term, tf = block.counts([t.encode() for t in texts])
    assert n.tolist() == [len(terms(t)) for t in texts]
    names = sorted([b"ab", b"b", "é".encode()])
    assert [(a, names[b], c) for a, b, c in zip(text, term, tf, strict=True)] == [
        (0, b"ab", 3), (0, b"b", 1), (2, "é".encode(), 1), (3, b"b", 1)
    ]
    assert [block.owners[a:b].tolist() for a, b in zip(block.first, block.first[1:], strict=False)] == [[0, 1], [0], [1]]


def test_best_keeps_ties_by_document():
    import pyarrow as pa

    rows = pa.table({"item": [0, 0, 0, 1, 0], "score": [5, 9, 5, 1, 5], "doc": ["c", "z", "a", "k", None]})
    got = lexical.best([rows, rows.slice(0, 0)], 3)
    assert got.to_pydict() == {"item": [0, 0, 0, 1], "score": [9, 5, 5, 1], "doc": ["z", "a", "c", "k"]}
    assert lexical.best([rows.slice(0, 0)], 3).num_rows == 0


def test_odd_tables(spark, tables):
    _, _, d, i = tables
    assert lexical.search(d.limit(0), i).count() == 0
    assert lexical.search(d, i.limit(0)).count() == 0
    assert lexical.search(d.withColumn("text", F.lit(None).cast("string")), i).count() == 0
    named = lexical.search(
        d.select(F.col("doc_id").cast("string").alias("k"), F.col("text").alias("body")), i, doc_id="k", text="body", top=2
    )
    assert named.columns == ["item_id", "rank", "k", "score"] and named.count() > 10


def test_long_numbers():
    # 50 * n * documents passes 64 bits; Python's numbers don't.
    assert 50 + 50 * 2**40 * 2**30 // 2**60 == 50 + 50 * 2**10 and np.iinfo(np.int64).max < 50 * 2**70


def test_few_terms_are_one_block(spark):
    pairs = spark.createDataFrame([(i, b"t%d" % (i % 7)) for i in range(100)], "item long, term binary").repartition(40)
    assert len(lexical.save_blocks(pairs)) == 1 and 5 <= len(lexical.save_blocks(pairs, 12)) <= 9
