"""Hand-made cases of single operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import losses
from tidewatch.operators import (
    compare, evaluate, graph, inject, panel, prepare, reconstruct, scoring, select, windows,
)
from tidewatch.plans import detectors

BY = ["series_id"]


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    pdf = pd.DataFrame(columns).assign(series_id=1, t=np.arange(n))
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, v in columns.items() if np.asarray(v).dtype == float})


def values(df, column, order="t"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_interpolation_edges(spark):
    nan = float("nan")
    df = series(spark, x=[nan, nan, 1.0, nan, 4.0, nan, nan], y=[nan] * 7)
    out = prepare.interpolate(df, BY, ["x", "y"])
    assert values(out, "x") == [1.0, 1.0, 1.0, 2.5, 4.0, 4.0, 4.0]
    assert values(out, "y") == [None] * 7


def test_labels_and_numbers(spark):
    df = spark.createDataFrame([(" A ttack",), ("Attack ",), ("Normal",)], "s string")
    assert [r[0] for r in df.select(prepare.attack_flag(F.col("s"))).collect()] == [1, 1, 0]
    df = spark.createDataFrame([("1.5",), ("bad",), ("NaN",)], "s string")
    assert [r[0] for r in df.select(prepare.coerce_numeric(F.col("s"))).collect()] == [1.5, None, None]
    with pytest.raises(ValueError):
        prepare.assert_no_nan(series(spark, x=[1.0, float("nan")]), ["x"])


def test_islands(spark):
    def found(bits):
        out = windows.segments(series(spark, y=bits), BY)
        return [(r["start_t"], r["end_t"]) for r in out.orderBy("seg_id").collect()]

    assert found([0, 1, 1, 0, 1, 1, 1]) == [(1, 2), (4, 6)]
    assert found([0, 0, 0]) == []
    assert found([1, 1]) == [(0, 1)]


def test_static_and_binary(spark):
    df = series(spark, zero=[0.0] * 4, one=[1.0] * 4, seven=[7.0] * 4, two=[-1.0, 1.0, 1.0, -1.0], many=[1.0, 2.0, 3.0, 4.0])
    names = ["zero", "one", "seven", "two", "many"]
    verdict = {r["feature"]: r["verdict"] for r in prepare.static_features(df, BY, names).collect()}
    assert verdict == {"zero": "sentinel", "one": "sentinel", "seven": "dropped", "two": "kept", "many": "kept"}
    binary = {r["feature"]: r["is_binary"] for r in prepare.two_valued(df, BY, names).collect()}
    assert binary == {"zero": True, "one": True, "seven": True, "two": True, "many": False}
    scaled = prepare.scale_standard(df, prepare.fit_moments(df, BY, ["seven"]), BY, ["seven"])
    assert values(scaled, "seven") == [0.0] * 4
    scaled = prepare.scale_minmax(df, prepare.fit_range(df, BY, ["seven"]), BY, ["seven"])
    assert values(scaled, "seven") == [0.0] * 4


def test_window_lengths(spark):
    df = series(spark, x=[1.0, 2.0, 3.0])
    assert windows.sliding(df, BY, ["x"], 3).collect()[0]["win"] == [[1.0], [2.0], [3.0]]
    assert windows.sliding(df, BY, ["x"], 4).count() == 0
    with pytest.raises(ValueError):
        windows.require_windows(df, BY, 4)
    with pytest.raises(ValueError):
        windows.sliding_grouped(df, BY, {0: []}, 2)


def test_lattice_length_and_mean(spark):
    rng = np.random.default_rng(0)
    scores = rng.random((50, 30))
    df = spark.createDataFrame([(1, i, s.tolist()) for i, s in enumerate(scores)], "series_id int, w int, score array<double>")
    out = windows.lattice(df, BY, "score", 5, 30).orderBy("p").toPandas()
    board = np.full((5, 54), np.nan)
    for i, s in enumerate(scores):
        board[i % 5, i : i + 5] = s[-5:]
    np.testing.assert_allclose(out["score"], np.nanmean(board, axis=0))
    assert list(out["t"]) == list(range(25, 79))


def test_point_adjust(spark):
    labels = series(spark, y=[0, 0, 0, 1, 1, 0, 1, 0, 0, 0])
    flagged = spark.createDataFrame([(1, 2), (1, 8)], "series_id int, w int")
    r = evaluate.point_adjust(labels, flagged, BY, 3).first()
    assert (r["tp"], r["fn"], r["fp"]) == (1, 1, 3)
    assert r["f1"] == pytest.approx(1 / 3)
    n = labels.groupBy("series_id").agg(F.count("*").alias("n"))
    cover = windows.window_cover(flagged, n, BY, 3)
    assert sorted(r["t"] for r in cover.collect()) == [2, 3, 4, 8, 9]


def test_segments_are_clipped(spark):
    df = series(spark, x=[0.0] * 5)
    segs = spark.createDataFrame([(1, -1, 0), (1, 3, 9), (1, 7, 8)], "series_id int, start_t long, end_t long")
    assert values(windows.paint_segments(df, segs, BY), "y") == [1, 0, 0, 1, 1]
    n = df.groupBy("series_id").agg(F.lit(3).cast("long").alias("n"))
    short = windows.pad_labels(series(spark, y=[1, 0, 1, 1]), n, BY)
    assert values(short, "y") == [1, 0, 1]


def brute_metrics(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, last = 0.0, 0.0
    for cut in sorted(set(s), reverse=True):
        hit = s >= cut
        recall, precision = (y[hit] == 1).sum() / len(pos), (y[hit] == 1).mean()
        ap, last = ap + (recall - last) * precision, recall
    return auc, ap


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 60), rng.integers(0, 9, 60) / 3.0
    df = series(spark, y=y, score=s)
    r = evaluate.ranking_metrics(df, BY).first()
    auc, ap = brute_metrics(y, s)
    assert r["roc_auc"] == pytest.approx(auc) and r["avg_precision"] == pytest.approx(ap)
    r = evaluate.ranking_metrics(df.withColumn("y", F.lit(1)), BY).first()
    assert r["roc_auc"] is None and r["avg_precision"] is None


def test_flag_is_strict_and_tail_score(spark):
    df = series(spark, score=[1.0, 2.0, 3.0])
    cut = scoring.fit_threshold(df, BY, 50.0)
    assert values(scoring.flag(df, cut, BY), "pred") == [0, 0, 1]
    got = spark.range(1).select(
        losses.tail_score(F.lit(5), F.lit(10)), losses.tail_score(F.lit(10), F.lit(10)), losses.tail_score(F.lit(0), F.lit(0))
    ).first()
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(27.631, abs=1e-3)
    assert got[2] == got[1]


def test_pca_reconstruction(spark):
    rng = np.random.default_rng(2)
    df = series(spark, a=rng.normal(size=40), b=rng.normal(size=40))
    wins = windows.flatten_windows(windows.sliding(df, BY, ["a", "b"], 4))
    full = reconstruct.WindowPca.fit(wins, 8)
    assert max(values(reconstruct.pca_errors(wins, full, ["series_id", "w"]), "score", "w")) < 1e-18
    part = reconstruct.WindowPca.fit(wins, 3)
    x = np.array(values(wins, "vec", "w"))
    c = x - x.mean(axis=0)
    basis = np.linalg.svd(c, full_matrices=False)[2][:3].T
    want = ((c - c @ basis @ basis.T) ** 2).mean(axis=1)
    np.testing.assert_allclose(values(reconstruct.pca_errors(wins, part, ["series_id", "w"]), "score", "w"), want)
    again = reconstruct.WindowPca.from_rows(part.to_rows(spark))
    np.testing.assert_array_equal(again.basis, part.basis)


def test_block_order_is_a_permutation_of_blocks():
    order = select.block_order(np.arange(200), 10, 1, 0)
    blocks = [list(b) for b in np.array_split(np.arange(10), 5)]
    for row in order:
        cut = [list(row[i : i + 2]) for i in range(0, 10, 2)]
        assert sorted(cut) == blocks
    assert len({tuple(r) for r in order}) > 50


def test_mask_importance(spark):
    """Shuffling a feature that follows another one hurts; an all-zero feature cannot."""
    rng = np.random.default_rng(4)
    a = np.cumsum(rng.normal(size=120))
    df = series(spark, a=a, b=a * 2, z=np.zeros(120))
    wins = windows.flatten_windows(windows.sliding(df, BY, ["a", "b", "z"], 8))
    model = reconstruct.WindowPca.fit(wins, 3)
    got = {r["feature"]: r["importance"] for r in select.mask_importance(wins.repartition(3), BY, ["a", "b", "z"], 8, model).collect()}
    assert got["a"] > 0 and got["b"] > 0 and abs(got["z"]) < 1e-12
    one = {r["feature"]: r["importance"] for r in select.mask_importance(wins.coalesce(1), BY, ["a", "b", "z"], 8, model).collect()}
    assert one == pytest.approx(got)


def test_clusters(spark):
    names = list("abcd")
    close = {("a", "b"): 0.95, ("c", "d"): 0.92, ("a", "c"): 0.2, ("a", "d"): 0.1, ("b", "c"): 0.3, ("b", "d"): 0.1}
    rows = [(1, i, j, close.get((i, j), close.get((j, i)))) for i in names for j in names if i != j]
    sim = spark.createDataFrame(rows, "series_id int, feature_i string, feature_j string, sim double")
    got = {r["feature"]: (r["cluster"], r["medoid"]) for r in select.cluster_redundant(sim, BY, names, 0.9).collect()}
    assert got == {"a": (1, "a"), "b": (1, "a"), "c": (2, "c"), "d": (2, "c")}
    dist = np.array([[0, 0.1, 0.4], [0.1, 0, 0.6], [0.4, 0.6, 0]])
    assert list(select._average_linkage(dist, 0.5)) == [1, 1, 1]
    assert list(select._average_linkage(dist, 0.49)) == [1, 1, 2]


def test_groups(spark):
    members = spark.createDataFrame(
        [(1, "a", 1, "a"), (1, "b", 1, "a"), (1, "c", 2, "c"), (1, "d", 3, "d")],
        "series_id int, feature string, cluster int, medoid string",
    )
    scores = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.5)], "series_id int, cluster int, importance double")
    flags = spark.createDataFrame([(1, "s")], "series_id int, feature string")
    out = select.assign_groups(members, scores, BY, 50.0, flags)
    got = {r["feature"]: (r["grp"], r["kind"]) for r in out.collect()}
    assert got == {
        "c": (0, "important"), "d": (1, "important"), "a": (2, "catch_all"), "b": (2, "catch_all"), "s": (3, "sentinel"),
    }
    want = members.select("series_id", "feature").unionByName(flags)
    assert select.check_partition(out, want, BY).count() == 0
    flags = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False)], "series_id int, feature string, is_binary boolean")
    assert select.adaptive_thresholds(flags, BY).first()[1:] == (0.95, 90)
    with pytest.raises(ValueError):
        select.group_modes(members, scores, BY, "other")


def test_graph_path(spark):
    nodes = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (0, "c", 6.0)], "t int, node string, x double")
    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    edges = spark.createDataFrame(links, "src string, dst string")
    got = {r["node"]: r["neighbour_mean"] for r in graph.neighbour_mean(nodes, edges, ["t"]).collect()}
    assert got == {"a": 2.0, "b": 3.5, "c": 2.0}
    adj = np.array([[2, 1, 0], [1, 2, 1], [0, 1, 2.0]])
    d = np.diag(adj.sum(axis=1) ** -0.5)
    want = d @ adj @ d @ np.array([1.0, 2.0, 6.0])
    got = {r["node"]: r["smoothed"] for r in graph.smooth(nodes, edges, nodes.select("node"), ["t"]).collect()}
    np.testing.assert_allclose([got[n] for n in "abc"], want)
    assert {r["node"]: r["residual"] for r in graph.residual(nodes, edges, ["t"]).collect()}["b"] == -1.5


def test_compare_with_nan(spark):
    nan = float("nan")
    rows = [(0, "none", "hard", 0.2), (0, "mlp", "hard", 0.3), (1, "none", "hard", 0.4), (1, "mlp", "hard", nan)]
    runs = spark.createDataFrame(rows, "seed int, variant string, type string, aucpr double")
    got = {r["variant"]: (r["mean_aucpr"], r["std_aucpr"]) for r in compare.variant_summary(runs, ["variant"], ["aucpr"]).collect()}
    assert got["mlp"] == (0.3, 0.0) and got["none"][0] == pytest.approx(0.3)
    wins = compare.win_counts(runs, ["seed", "type"], ["variant"], "aucpr").first()
    assert (wins["wins"], wins["n"]) == (1, 2)
    trials = spark.createDataFrame(
        [("s", 0, "COMPLETE", -1.0, {}), ("s", 1, "COMPLETE", 0.5, {"kl_weight": 0.3}), ("s", 2, "PRUNED", 0.9, {}), ("s", 3, "COMPLETE", 0.5, {})],
        "study string, trial int, state string, value double, params map<string,double>",
    )
    assert compare.best_trial(trials).first()["trial"] == 1
    assert compare.best_trial(trials, "minimize").first()["trial"] == 0
    assert values(compare.running_best(trials, size=2), "best", "trial") == [0.0, 0.5, 0.5]


def cosine_ramp(length, ramp):
    r = max(1, min(ramp, (length - 1) // 2))
    w = np.ones(length)
    edge = 0.5 * (1 - np.cos(np.pi * np.linspace(0, 1, r)))
    w[:r], w[-r:] = edge, edge[::-1]
    return w


def test_injection(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=120) + 5
    df = series(spark, x=x)
    kinds = ["dropout", "sign_flip", "time_warp"]
    segs = spark.createDataFrame([(1, 0, k, 40, 20, 4) for k in kinds], "series_id int, seg_id int, type string, start long, len long, ramp long")
    w = cosine_ramp(20, 4)
    seg = x[40:60]

    def changed(out):
        got = np.array(values(out, "x"))
        np.testing.assert_array_equal(got[:40], x[:40])
        np.testing.assert_array_equal(got[60:], x[60:])
        return got[40:60]

    np.testing.assert_allclose(changed(inject.dropout(df, segs, BY, ["x"])), seg * (1 - w) + x[39] * w)
    np.testing.assert_allclose(changed(inject.sign_flip(df, segs, BY, ["x"])), seg * (1 - w) - seg * w)
    got = changed(inject.time_warp(df, segs, BY, ["x"]))
    fits = []
    for factor in inject.WARP_FACTORS:
        at = np.clip(np.arange(20) * factor, 0, 19)
        fits.append(np.allclose(got, seg * (1 - w) + np.interp(np.arange(20), at, seg) * w))
    assert any(fits)


@pytest.mark.parametrize("factor", [0.7, 1.3])
def test_warp_position(spark, factor):
    n = 23
    pos = spark.range(n).select(inject.warp_position(F.col("id"), F.lit(n), F.lit(factor)).alias("p"))
    p = np.array([r["p"] for r in pos.collect()])
    seg = np.random.default_rng(0).normal(size=n)
    lo, part = np.floor(p).astype(int), p - np.floor(p)
    mine = seg[lo] + (seg[np.ceil(p).astype(int)] - seg[lo]) * part
    want = np.interp(np.arange(n), np.clip(np.arange(n) * factor, 0, n - 1), seg)
    np.testing.assert_allclose(mine, want, atol=1e-9)


def test_placement_never_overlaps(spark):
    lengths = spark.range(40).select(F.col("id").alias("series_id"), (600 + F.col("id") * 7).alias("n"))
    segs = inject.place(lengths, BY, ["a", "b", "c"], seed=3).toPandas().sort_values(["series_id", "start"])
    assert len(segs) == 120 and segs["len"].between(45, 90).all()
    for _, part in segs.groupby("series_id"):
        ends = (part["start"] + part["len"]).to_numpy()
        assert (part["start"].to_numpy()[1:] - ends[:-1] >= 6).all()


def test_injected_faults_are_found(spark):
    """Spikes and dropouts on a smooth panel are ranked above their share."""
    t = np.arange(600)
    frames = [pd.DataFrame({"series_id": s, "t": t, "x": np.sin(t / 9 + s)}) for s in range(4)]
    df = spark.createDataFrame(pd.concat(frames))
    lengths = df.groupBy("series_id").agg(F.count("*").alias("n"))
    segs = inject.place(lengths, BY, ["spike", "dropout"], seed=1)
    bad = inject.spike(df, segs, BY, ["x"], noise_std=1.0)
    bad = inject.dropout(bad, segs, BY, ["x"])
    truth = inject.type_labels(df, segs, BY, ["spike", "dropout"])
    detector = detectors.PcaDetector(BY, ["x"], 20, k=3)
    flags = windows.align_end(detector.fit(df).transform(bad), truth, BY, 20)
    r = evaluate.ranking_metrics(flags, []).first()
    assert r["avg_precision"] > 1.5 * r["n_pos"] / (r["n_pos"] + r["n_neg"])


def test_external_model_and_group_losses(spark):
    df = series(spark, a=[0.0, 1.0, 1.0], b=[2.0, 4.0, 6.0])
    pairs = df.select("series_id", F.array("a").alias("x_0"), F.array(F.lit(0.5)).alias("xhat_0"), F.array("b").alias("x_1"), F.array(F.lit(1.0)).alias("xhat_1"), "t")
    got = scoring.group_losses(pairs, ["t"], {0: True, 1: False})
    bce = values(got.where("grp = 0"), "loss")
    assert bce[0] == pytest.approx(np.log1p(np.exp(0.5))) and bce[1] == pytest.approx(np.log1p(np.exp(-0.5)))
    assert values(got.where("grp = 1"), "loss") == [1.0, 9.0, 25.0]
    grid = panel.regular_grid(df.where("t <> 1").withColumn("t", F.col("t") + 5), BY, size=2)
    assert [(r["t"], r["a"]) for r in grid.orderBy("t").collect()] == [(0, 0.0), (1, None), (2, 1.0)]
