import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import prefixes

KIND = "conv_id long, turn long, role string, text string, depth string, n long"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The nodes by walking every prefix of every conversation."""
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members, kids = {}, {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
            if d:
                kids.setdefault(ts[: d - 1], set()).add(ts[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, ())
        leaves[node] = sum(leaves[k] for k in below) or 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[k] for k in below)
    out = []
    for node, mine in members.items():
        ends = ",".join(str(c) for c in sorted(mine) if built[c] == node)
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(mine), len(node), parent, len(mine), len(kids.get(node, ())), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == FIELDS
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed):
    r = random.Random(seed)
    said = ["", "a", "bb", "ü", "東京!", None]
    rows = []
    for c in [*range(60), 100, 103, 104, 205, 300, 301]:
        for t in range(r.choice([1, 2, 3, 6, 9])):
            rows.append((c, t, r.choice(["user", "user", None]), r.choice(said), "x", 1))
    # Copies, one of them long, and conversations that leave it late.
    long = [("user" if t % 2 else "tool", f"t{t % 7}") for t in range(700)]
    for c in (400, 401, 402, 450):
        rows += [(c, t, *x, "y", 2) for t, x in enumerate(long)]
    rows += [(460, t, *x, "y", 2) for t, x in enumerate(long[:90])] + [(470, t, *x, "y", 2) for t, x in enumerate(long[:512])]
    rows += [(480, t, *x, "y", 2) for t, x in enumerate([*long[:600], ("user", "other")])]
    for c in range(500, 560):
        rows += [(c, 0, "user", "same", None, None), (c, 1, "tool", "same too", None, None)]
    rows += [(560, None, "user", "first", "z", 0), (560, 0, "user", "second", "z", 0), (None, 1, "user", "nobody", "z", 0)]
    # A repeated row is a further turn.
    rows += [(570, 0, "user", "twice", "z", 0), (570, 0, "user", "twice", "z", 0)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("local,bucket", [(prefixes.LOCAL, None), (3, 16)])
def test_against_plain_version(spark, local, bucket):
    rows = made(local)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    assert rows_of(prefixes.trie(df, local=local, bucket=bucket)) == plain(rows)


def test_every_group_too_large_for_a_task(spark):
    rows = [(c, t, "u", x, None, None) for c in range(7) for t, x in enumerate("abcde"[: c % 4 + 1])]
    assert rows_of(prefixes.trie(spark.createDataFrame(rows, KIND), local=0)) == plain(rows)


def test_joined_ids_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "JOINED", 7)
    convs = [(c, 2, 5, c % 2) for c in range(101)] + [(9, 3, 5, 0)]
    got = prefixes.ended(spark.createDataFrame(convs, "conv long, depth long, k1 long, k2 long").repartition(3))
    want = {}
    for c, *key in sorted(convs):
        want.setdefault(tuple(key), []).append(str(c))
    want = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
    assert {(r.depth, r.k1, r.k2): r.ends for r in got.collect()} == want


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None)], KIND)
    assert prefixes.trie(df).count() == 0 and prefixes.trie(df.limit(0)).count() == 0
    one = [(5, None, None, None, None, None)]
    assert rows_of(prefixes.trie(spark.createDataFrame(one, KIND))) == plain(one)
    rows = made(8)
    df = spark.createDataFrame(rows, KIND)
    named = df.select(F.col("conv_id").alias("c"), F.col("turn").alias("at"), F.col("role").alias("who"), F.col("text").alias("said"))
    assert rows_of(prefixes.trie(named, "c", "at", "who", "said")) == plain(rows)


def test_cuts():
    assert prefixes.cuts(0) == [0] and prefixes.cuts(8) == [0, 8] and prefixes.cuts(513) == [0, 8, 64, 512, 4096]
    far = prefixes.cuts(300_000)
    assert all(b - a <= prefixes.WIDEST for a, b in zip(far, far[1:], strict=False)) and far[-1] >= 300_000
