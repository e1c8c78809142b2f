"""The selection chain against plain numpy versions of its stages."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import select, selection, spread

BY = ["series_id"]
NAMES = ["a", "b", "c", "d", "e", "f"]


def greedy(dist, cut):
    """Average linkage by the nearest pair of all, again and again."""
    groups = [[i] for i in range(len(dist))]
    while len(groups) > 1:
        far = [(np.mean(dist[np.ix_(p, q)]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j]
        best, i, j = min(far)
        if best > cut:
            break
        groups[i] += groups.pop(j)
    label = np.zeros(len(dist), int)
    for g in groups:
        label[g] = min(g)
    return pd.factorize(label)[0] + 1


@pytest.mark.parametrize("seed", range(12))
def test_chain_linkage(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 7, 40):
        m = rng.random((n, n)) if seed % 3 else np.abs(np.subtract.outer(x := rng.random(n) * 3, x))
        dist = (m + m.T) / 2
        np.fill_diagonal(dist, 0)
        for cut in (-1.0, 0.05, 0.3, 0.45, 0.6, 9.0):
            assert list(select._average_linkage(dist, cut)) == list(greedy(dist, cut)), (n, cut)


def test_chain_linkage_of_many_features():
    rng, n = np.random.default_rng(1), 3000
    x = rng.normal(size=(n, 3))
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(n, 1)]
    began = time.time()
    got = select.linked_clusters(dist, n, 1.0)
    assert time.time() - began < 60 and 10 < got.max() < n
    ties = select.linked_clusters(np.ones(300 * 299 // 2), 300, 1.0)
    assert ties.max() == 1


def panel(spark):
    """Series 1 has six features, of which e is constant; 2 lacks some; 3 has one that varies; 4 is too short for a model."""
    rng, rows = np.random.default_rng(3), []
    for s, n in ((1, 150), (2, 90), (3, 60), (4, 7), (None, 80)):
        a, c, f = (np.cumsum(rng.normal(size=n)) for _ in range(3))
        x = {"a": a, "b": a * 2 + rng.normal(size=n) * 0.01, "c": c, "d": (rng.random(n) > 0.5) * 1.0, "e": np.full(n, 5.0), "f": f}
        if s == 2:
            x |= {"c": [None] * n, "e": np.ones(n)}
        if s == 3:
            x = {k: np.zeros(n) for k in x} | {"c": c}
        rows += [(s, t, *(None if x[k][t] is None else float(x[k][t]) for k in NAMES)) for t in range(n)]
    kinds = ", ".join(f"{k} double" for k in NAMES)
    return spark.createDataFrame(rows, f"series_id int, t long, {kinds}").repartition(4).cache()


def brute_importance(x, salt, length, k, repeats=3, share=0.3):
    n, width = x.shape
    q = np.percentile(x, [25, 50, 75], axis=0)
    spread_ = np.where(q[2] > q[0], q[2] - q[0], 1.0)
    x = (x - q[1]) / spread_
    wins = np.lib.stride_tricks.sliding_window_view(x, length, axis=0).transpose(0, 2, 1)
    held = max(1, int(np.round(len(wins) * share)))
    cut = len(wins) - held
    flat = wins.reshape(len(wins), -1)
    learned = flat[:cut] - flat[:cut].mean(axis=0)
    basis = np.linalg.svd(learned, full_matrices=True)[2][: min(k, flat.shape[1])].T
    mean, out = flat[:cut].mean(axis=0), []
    clean = (flat[cut:] - mean) @ basis @ basis.T + mean - flat[cut:]
    draws = select._mixed(np.arange(cut, len(wins)).astype(np.uint64) + np.uint64(salt & (2**63 - 1)))
    for f in range(width):
        rise = []
        for r in range(repeats):
            y = wins[cut:].copy()
            y[:, :, f] = np.take_along_axis(y[:, :, f], select.block_order(draws, length, f, r), axis=1)
            worse = (y.reshape(clean.shape) - mean) @ basis @ basis.T + mean - flat[cut:]
            rise.append((worse**2).mean() - (clean**2).mean())
        out.append(np.mean(rise))
    return out


@pytest.mark.parametrize("size", [None, 11])
def test_own_importance(spark, size):
    df = panel(spark)
    own = {1: ["a", "c", "f"], 2: ["f"], None: ["b", "d"], 4: ["a"]}
    members = spark.createDataFrame([(s, f) for s, fs in own.items() for f in fs], "series_id int, feature string")
    got = {(r.series_id, r.feature): r.importance for r in selection.own_importance(df, BY, members, NAMES, 8, 4, size=size).collect()}
    assert set(got) == {(s, f) for s, fs in own.items() for f in fs} and got[4, "a"] is None
    salts = {r.series_id: r.salt for r in df.select("series_id", F.xxhash64("series_id", F.lit(42)).alias("salt")).distinct().collect()}
    for s in (1, 2, None):
        x = df.where(F.col("series_id").eqNullSafe(F.lit(s))).orderBy("t").select(own[s]).toPandas().to_numpy(float)
        for f, want in zip(own[s], brute_importance(x, salts[s], 8, 4), strict=True):
            assert got[s, f] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_whole_chain(spark):
    df = panel(spark)
    groups = selection.select_features(df, BY, NAMES, 8, max_lag=3, k=4).cache()
    found = {s: {} for s in (1, 2, 3, 4, None)}
    for r in groups.collect():
        assert found[r.series_id].setdefault(r.feature, (r.grp, r.kind)) == (r.grp, r.kind)
    # e is constant 5 in series 1 and gone, constant 1 in series 2 and a sentinel; c is no feature of series 2.
    assert set(found[1]) == {"a", "b", "c", "d", "f"} == set(found[None])
    assert set(found[2]) == {"a", "b", "d", "e", "f"} and found[2]["e"][1] == "sentinel"
    assert found[1]["a"] == found[1]["b"] and len({found[1][f] for f in "acf"}) > 1
    # A lone feature is a cluster of one, and the rest of its series are constant zeros.
    assert found[3]["c"] == (0, "important") and {v for f, v in found[3].items() if f != "c"} == {(1, "sentinel")}
    for mine in found.values():
        assert {g for g, _ in mine.values()} == set(range(len({g for g, _ in mine.values()})))
    own = selection.own_features(df, BY, NAMES)
    expected = own.where("verdict <> 'dropped'").select(*BY, "feature")
    assert select.check_partition(groups, expected, BY).count() == 0


def test_thresholds_of_each_series(spark):
    """Two features at similarity 0.93: one cluster at 0.9, two at 0.95; percentiles per series likewise."""
    sim = spark.createDataFrame([(s, i, j, 0.93) for s in (1, 2) for i, j in (("a", "b"), ("b", "a"))], "series_id int, feature_i string, feature_j string, sim double")
    members = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.9), (2, "a", 0.95), (2, "b", 0.95), (3, "c", 0.9)], "series_id int, feature string, corr_threshold double")
    got = {(r.series_id, r.feature): (r.cluster, r.medoid) for r in select.cluster_members(members, sim, BY, ["a", "b", "c"]).collect()}
    assert got == {(1, "a"): (1, "a"), (1, "b"): (1, "a"), (2, "a"): (1, "a"), (2, "b"): (2, "b"), (3, "c"): (1, "c")}
    scores = spark.createDataFrame([(s, c, float(c)) for s in (1, 2) for c in range(1, 12)], "series_id int, cluster int, importance double")
    own = scores.select("series_id", F.concat(F.lit("f"), "cluster").alias("feature"), "cluster")
    cuts = spark.createDataFrame([(1, 50), (2, 90)], "series_id int, importance_percentile int")
    rows = select.assign_groups(own, scores, BY, cuts).where("kind = 'important'").groupBy("series_id").count().collect()
    assert {r["series_id"]: r["count"] for r in rows} == {s: sum(c >= np.percentile(range(1, 12), p) for c in range(1, 12)) for s, p in ((1, 50), (2, 90))}


def test_linkage_takes_many_series_in_one_call(spark):
    """Series with null and repeated keys, own features and thresholds, cut over batches; no group goes to Python by itself."""
    rng, names = np.random.default_rng(2), list("abcdefg")
    members, sim, want = [], [], {}
    for k in [None, *range(40)]:
        mine = sorted(rng.choice(7, rng.integers(1, 8), replace=False).tolist())
        cut = float(rng.choice([0.3, 0.6, 0.9]))
        members += [(k, f"x{k}" if k else None, names[i], cut) for i in mine] * (2 if k == 3 else 1)
        dist = np.ones((7, 7))
        for i in range(7):
            for j in range(i):
                if rng.random() < 0.8:
                    dist[i, j] = dist[j, i] = 1 - (x := float(rng.random()))
                    sim += [(k, f"x{k}" if k else None, names[a], names[b], x) for a, b in ((i, j), (j, i))]
        found = select._average_linkage(dist[np.ix_(mine, mine)], 1 - cut)
        want |= {(k, names[i]): int(c) for i, c in zip(mine, found)}
    sim.append((99, "without", "a", "b", 0.9))
    members = spark.createDataFrame(members, "k long, s string, feature string, corr_threshold double").repartition(5)
    sim = spark.createDataFrame(sim, "k long, s string, feature_i string, feature_j string, sim double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = select.linked_members(members, sim, ["k", "s"], names)
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.feature): r.cluster for r in rows} == want and len(rows) == len(want)
    plan = out._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "FlatMapGroups" not in plan


def test_no_side_of_the_chain_is_broadcast_by_the_bytes_of_its_files(spark, monkeypatch):
    """Small files may hold more rows than the driver can: beyond the lookup limit all joins are sorted ones."""
    df, plans, durable = panel(spark), [], spread.durable

    def seen(table):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return durable(table)

    def found():
        groups = selection.select_features(df, BY, NAMES, 8, max_lag=3, k=4)
        plans.append(groups._jdf.queryExecution().executedPlan().toString())
        return sorted(map(str, groups.collect()))

    want = found()
    monkeypatch.setattr(spread, "LOOKUP_LIMIT", 0)
    monkeypatch.setattr(spread, "durable", seen)
    plans.clear()
    assert found() == want
    assert not any("Broadcast" in p for p in plans)
    assert sum("SortMergeJoin" in p for p in plans) > 3
