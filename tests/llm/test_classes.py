import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import classes as c

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [w.encode() for w in SPLIT.findall((text or "").translate({x: x + 32 for x in range(65, 91)}))]


def cases():
    r = random.Random(1)
    det, noun, verb = ["the", "a", "Every"], [f"noun{i}" for i in range(30)], [f"verbs{i}" for i in range(20)]
    text = lambda n: " ".join(f"{r.choice(det)} {r.choice(noun)} {r.choice(verb)}" for _ in range(n))
    rows = [(i, text(r.randint(0, 30)) + (f" rare{i} ÄÖ" if i % 3 else "")) for i in range(150)]
    return rows + [(None, None), (200, ""), (7, rows[7][1]), (7, rows[7][1]), (201, "unseen words only here")]


@pytest.mark.parametrize("frequent", [200_000, 20, 0])
def test_against_plain_version(spark, monkeypatch, frequent):
    monkeypatch.setattr(c, "FREQUENT", frequent)
    rows = cases()
    df = spark.createDataFrame([(i, (i or 0) % 5 == 1, t) for i, t in rows], "id long, held_out boolean, raw string")
    df = df.withColumn("raw", F.col("raw").cast("binary"))
    model, counts = c.fit(df.where("not held_out"), "raw", items=30, classes=8)
    got = c.score(df, model, counts).collect()
    train = Counter(w for i, t in rows if (i or 0) % 5 != 1 for w in [*tokens(t), c.END])
    n, v = sum(train.values()), len(train)
    assert {bytes(r.w): r.c for r in counts.collect()} == train and (model.tokens, model.types) == (n, v)
    items = c.Items(model.own)
    kind = lambda w: model.of[items[w]]
    size, types = Counter(), Counter()
    for w, k in train.items():
        size[kind(w)] += k
        types[kind(w)] += 1

    def scores(text):
        base = total = known = 0
        prev = c.END
        for w in [*tokens(text), c.END]:
            k = train[w]
            known += k > 0
            base += math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
            emit = (k + 0.5) / (size[kind(w)] + 0.5 * (types[kind(w)] + 1))
            total += model.transition[kind(prev), kind(w)] + math.log10(emit)
            prev = w
        return len(tokens(text)) + 1, known, round(base, 6), round(total, 6)

    want = sorted(((i, (i or 0) % 5 == 1, *scores(t)) for i, t in rows), key=repr)
    mine = [(r.id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(mine, key=repr) == want and {r.train_tokens for r in got} == {n}
    # The model is a distribution, and knows more of held-out texts than word counts do.
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    if frequent:
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def likelihood(pairs, of):
    k = of.max() + 1
    m = np.zeros((len(of), k))
    m[np.arange(len(of)), of] = 1
    joint = m.T @ pairs @ m
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(joint) - f(joint.sum(axis=0)) - f(joint.sum(axis=1))


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(3)
    pairs = np.zeros((31, 31))
    for i in range(30):
        for j in range(30):
            pairs[i, j] = r.poisson(40 if (i % 3 + 1) % 3 == j % 3 else 0.2)
    pairs[30, :] = pairs[:, 30] = 1
    of = c.exchange(pairs, 4, 20)
    assert all(len(set(of[k:30:3])) == 1 for k in range(3)) and of[30] == 3 and len(set(of)) == 4
    start = np.append(np.arange(30) % 3, 3)
    assert likelihood(pairs, of) >= likelihood(pairs, start) - 1e-6


def test_rare_words_have_the_class_of_their_own_bigrams(spark, monkeypatch):
    """Words beyond the items, of any ending, are classed by what stands around them, in small stretches and ranges too."""
    monkeypatch.setattr(c, "NEAR", 300)
    r = random.Random(4)
    det, verb = ["the", "a", "every", "no"], ["runs", "sits", "eats", "naps"]
    nouns = [f"n{i}x{i * 7919 % 100:02d}" for i in range(300)]
    adverbs = [f"d{i}x{i * 7919 % 100:02d}" for i in range(300)]
    rows = []
    for i in range(900):
        parts = [f"{r.choice(det)} {nouns[(i + k * 37) % 300]} {r.choice(verb)} {adverbs[(i + k * 41) % 300]}" for k in range(4)]
        rows.append((" ".join(parts),))
    model, counts = c.fit(spark.createDataFrame(rows, "raw string").repartition(6), "raw", items=8, classes=6)
    assert set(model.own) == {w.encode() for w in det + verb}
    items = c.Items(model.own)
    kinds = [Counter(int(model.of[items[w.encode()]]) for w in words) for words in (nouns, adverbs)]
    assert kinds[0].keys() & kinds[1].keys() == set()
    # Transitions are those of the classes that the words ended in.
    sizes = Counter()
    for w, n in {bytes(x.w): x.c for x in counts.collect()}.items():
        sizes[int(model.of[items[w]])] += n
    assert sum(sizes[k] for k in kinds[0]) >= 3600 and sum(sizes[k] for k in kinds[1]) >= 3600
    # A word that was not in training has the class of its shape.
    shape = len(model.own) + c.zlib.crc32(b"en") % c.SHAPES
    assert items[b"unseen"] == shape


def test_texts_are_cut_into_words_twice(spark):
    """Once to count and once to number them, not for each table of the model; a text's numbers give the items of its words."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, False, (t or "").encode()) for i, t in cases()]
    schema = "id long, held_out boolean, raw binary"
    df = spark.createDataFrame(rows, schema).mapInArrow(passed, schema)
    model, counts = c.fit(df, "raw", items=5, classes=6)
    assert read.value == 2 * len(rows)
    frequent = {w: n for w, n in model.frequent.items() if n > 3}
    texts = c.coded(df, frequent, model.ends).select("codes", "hashes", "rare", "times", "id").collect()
    listed = [w for w in frequent if w != c.END]
    lookup, items = c.Lookup(c.Listed(listed), model.own), c.Items(model.own)
    raws = sorted(rows, key=repr)
    batch = c.pa.RecordBatch.from_pylist([{"codes": bytes(r.codes), "hashes": bytes(r.hashes)} for r in texts])
    got = np.concatenate([x[1] for x in lookup.texts(batch.slice(1))])
    raw_of = {i: raw for i, _, raw in raws}
    want = [items.end, *(x for r in texts[1:] for w in [*c.words_of(raw_of[r.id]), c.END] for x in [items[w]])]
    assert got.tolist() == want
    for r in texts:
        rare = Counter(w for w in c.words_of(raw_of[r.id]) if w not in frequent)
        assert dict(zip(map(bytes, r.rare), r.times, strict=True)) == rare


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, True, b"some words")], "id long, held_out boolean, raw binary")
    model, counts = c.fit(df.where("not held_out"), "raw")
    r = c.score(df, model, counts).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert c.score(df.limit(0), model, counts).count() == 0
