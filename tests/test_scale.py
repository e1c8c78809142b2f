"""The routes for large groups give the same rows as the plain ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluate, prepare, scoring, select, spread, windows
from tidewatch.plans import detect_queries


@pytest.fixture(scope="module")
def hot(spark):
    """Three series; one holds most of the rows. Values repeat."""
    rng = np.random.default_rng(1)
    parts = []
    for series, n in (("a", 700), ("b", 40), ("c", 31)):
        x = rng.integers(0, 25, n) / 4.0
        y = (rng.random(n) < 0.3).astype(int)
        gap = np.where(rng.random(n) < 0.4, np.nan, x)
        parts.append(pd.DataFrame({"series_id": series, "t": np.arange(n), "x": x, "y": y, "gap": gap}))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf).withColumn("gap", F.when(~F.isnan("gap"), F.col("gap")))
    return df.repartition(5), pdf


def rows(df):
    return sorted(map(str, df.collect()))


def close(a, b, keys):
    a = a.toPandas().sort_values(keys).reset_index(drop=True)
    b = b.toPandas().sort_values(keys).reset_index(drop=True)[a.columns]
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, check_dtype=False)


BY = ["series_id"]


@pytest.mark.parametrize("by", [["series_id"], []])
def test_running_totals_split(hot, by):
    df, _ = hot
    order = [F.col("x"), F.col("series_id"), F.col("t")]
    plain = spread.running_totals(df, by, order, {"c": F.lit(1), "s": F.col("x")})
    split = spread.running_totals(df, by, order, {"c": F.lit(1), "s": F.col("x")}, limit=50)
    assert rows(plain) == rows(split)


def test_running_totals_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, x int")
    got = spread.running_totals(df, ["g"], [F.col("x")], {"s": F.col("x")}, limit=1)
    assert rows(got.select("g", "x", "s")) == rows(
        spread.running_totals(df, ["g"], [F.col("x")], {"s": F.col("x")}).select("g", "x", "s")
    )


def test_row_index_split(hot):
    df, _ = hot
    got = spread.row_index(df.withColumnRenamed("t", "at"), BY, ["at"], limit=10)
    assert got.where("t <> at").count() == 0 and got.count() == 771


@pytest.mark.parametrize("limit", [None, 20])
def test_percentiles(hot, limit):
    df, pdf = hot
    points = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["series_id"]: r["q"] for r in spread.percentiles(df, BY, "x", points, limit).collect()}
    for series, part in pdf.groupby("series_id"):
        np.testing.assert_allclose(got[series], np.quantile(part["x"], points), rtol=1e-12)


def test_percentiles_overall_split(hot):
    df, pdf = hot
    got = spread.percentiles(df, [], "x", [0.9], limit=10).first()["q"][0]
    assert got == pytest.approx(np.quantile(pdf["x"], 0.9))


def test_lookup_join_salted(hot):
    df, _ = hot
    stats = df.groupBy("series_id").agg(F.avg("x").alias("m"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = spread.lookup_join(df, stats.where("series_id <> 'b'"), BY, how)
        salted = spread.lookup_join(df, stats.where("series_id <> 'b'"), BY, how, limit=0)
        assert rows(plain) == rows(salted)


def test_salted_copies_are_not_broadcast(hot):
    """The copies' files may be small, though they were too many rows to broadcast even once."""
    df, _ = hot
    stats = df.groupBy("series_id").agg(F.avg("x").alias("m"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plan = spread.lookup_join(df, stats, BY, how, limit=0)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bucket_running(hot):
    df, pdf = hot
    got = spread.bucket_running(df, BY, {"s": F.col("x")}, {"m": F.col("x")}, size=16).toPandas()
    got = got.sort_values(["series_id", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["series_id", "t"]).reset_index(drop=True)
    np.testing.assert_allclose(got["s"], want.groupby("series_id")["x"].cumsum())
    np.testing.assert_allclose(got["m"], want.groupby("series_id")["x"].cummax())


def test_bucketed_windows(hot):
    df, _ = hot
    assert rows(windows.sliding(df, BY, ["x"], 12)) == rows(windows.sliding(df, BY, ["x"], 12, size=12))
    assert rows(windows.diff(df.select("series_id", "t", "x"), BY, ["x"])) == rows(
        windows.diff(df.select("series_id", "t", "x"), BY, ["x"], size=3)
    )
    assert rows(windows.segments(df, BY)) == rows(windows.segments(df, BY, size=4))
    close(
        scoring.window_mean_error(df, BY, ["x"], 10), scoring.window_mean_error(df, BY, ["x"], 10, size=11), BY + ["w"]
    )
    assert rows(windows.lag_align(df, BY, "x", "y", 3)) == rows(windows.lag_align(df, BY, "x", "y", 3, size=6))
    with pytest.raises(ValueError):
        windows.sliding(df, BY, ["x"], 12, size=5)


@pytest.mark.parametrize("size", [None, 7, 1])
def test_interpolate_buckets(hot, size):
    df, pdf = hot
    got = prepare.interpolate(df.select("series_id", "t", "gap"), BY, ["gap"], size=size).toPandas()
    got = got.sort_values(["series_id", "t"])
    want = pdf.sort_values(["series_id", "t"]).groupby("series_id")["gap"].transform(lambda s: s.interpolate().bfill().ffill())
    np.testing.assert_allclose(got["gap"], want)


def test_ranks_and_metrics_split(hot):
    df, pdf = hot
    got = windows.average_rank(df, BY, "x", limit=5).toPandas().sort_values(["series_id", "t"])
    want = pdf.sort_values(["series_id", "t"]).groupby("series_id")["x"].rank()
    np.testing.assert_allclose(got["rank"], want)
    close(
        evaluate.ranking_metrics(df, BY, "x"), evaluate.ranking_metrics(df, BY, "x", limit=5), BY
    )


def test_ecdf_split(hot):
    df, pdf = hot
    losses = df.select("series_id", "t", F.col("x").alias("loss"))
    ecdf = scoring.fit_ecdf(losses.where("t < 30"), BY, quantiles=None)
    got = scoring.count_below(losses, ecdf, BY, ["t"], limit=5).toPandas()
    for series, part in pdf.groupby("series_id"):
        base = np.sort(part["x"].to_numpy()[:30])
        mine = got[got["series_id"] == series].sort_values("t")
        np.testing.assert_array_equal(mine["below"], np.searchsorted(base, part["x"], side="right"))


def test_point_adjust_buckets(hot):
    df, _ = hot
    flagged = df.where("x > 5.5").select("series_id", F.col("t").alias("w"))
    close(evaluate.point_adjust(df, flagged, BY, 4), evaluate.point_adjust(df, flagged, BY, 4, size=5), BY)


def test_results_do_not_depend_on_partitions(hot):
    df, _ = hot
    one = prepare.split_random(df.coalesce(1), BY, "t", {"val": 0.3})
    many = prepare.split_random(df.repartition(7), BY, "t", {"val": 0.3}, limit=9)
    assert rows(one) == rows(many)
    counts = {(r[0], r[1]): r[2] for r in one.groupBy("series_id", "split").count().collect()}
    assert counts[("a", "val")] == 210 and counts[("c", "val")] == 10


def spearman_brute(values, max_lag, decay):
    d = np.diff(values, axis=0)
    n, f = d.shape
    sim = np.zeros((f, f))
    for tau in range(-min(max_lag, n // 2), min(max_lag, n // 2) + 1):
        x, y = (d[: n - tau], d[tau:]) if tau >= 0 else (d[-tau:], d[: n + tau])
        rx, ry = pd.DataFrame(x).rank().to_numpy(), pd.DataFrame(y).rank().to_numpy()
        with np.errstate(all="ignore"):
            rho = np.nan_to_num(np.corrcoef(rx.T, ry.T)[:f, f:])
        sim = np.maximum(sim, np.abs(rho) * (np.exp(-abs(tau) / decay) if decay else 1.0))
    np.fill_diagonal(sim, 1.0)
    return np.maximum(sim, sim.T)


@pytest.mark.parametrize("decay,tile,limit", [(None, 8, None), (5.0, 2, 3)])
def test_lagged_spearman(spark, monkeypatch, decay, tile, limit):
    monkeypatch.setattr(select, "TILE", tile)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 6, (40, 3)).astype(float)
    values = np.column_stack([base, np.roll(base[:, 0], 2), np.full(40, 2.0)])
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(pd.DataFrame(values, columns=names).assign(series_id=1, t=np.arange(40)))
    got = select.lagged_spearman(df, BY, names, 4, decay, size=9, limit=limit).collect()
    want = spearman_brute(values, 4, decay)
    assert len(got) == 20
    for r in got:
        assert r["sim"] == pytest.approx(want[names.index(r["feature_i"]), names.index(r["feature_j"])], abs=1e-9)


@pytest.mark.parametrize("limit", [None, 0])
def test_node_errors_from_a_panel_made_once(spark, tmp_path, monkeypatch, limit):
    """Sums and maxima of node errors, from one aggregation of the items, also where the fitted values are not broadcast."""
    if limit is not None:
        monkeypatch.setattr(spread, "LOOKUP_LIMIT", limit)
    rows = [(1, 5.0, 100.0, 0.1, "A", "F", "1992-01-05"), (1, 7.0, 50.0, 0.2, "A", "F", "1992-01-09"),
            (1, 2.0, 30.0, 0.0, "A", "F", "1992-02-01"), (1, 4.0, 20.0, 0.3, "N", "O", "1992-02-03"),
            (2, 9.0, None, 0.1, "R", "F", "1993-03-01"), (None, 1.0, 2.0, 0.5, "R", "F", "1993-03-01")]
    kind = "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, d string"
    items = spark.createDataFrame(rows, kind).withColumn("l_shipdate", F.to_timestamp("d")).drop("d")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    cells = detect_queries.node_cells(spark, str(tmp_path))
    assert not any("lineitem" in f for f in cells.inputFiles())
    panels = {}
    for s, q, p, d, a, b, day in rows:
        t = (int(day[:4]) - 1992) * 12 + int(day[5:7]) - 1
        for m, x in (("qty", q), ("price", p), ("disc", d)):
            at = panels.setdefault((s, a + b, m), {})
            at[t] = x if at.get(t) is None else at[t] + (x or 0)
    want = {}
    for (s, node, m), at in panels.items():
        x = [v for v in at.values() if v is not None]
        mean = sum(x) / len(x) if x else 0.0
        std = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5 if x else 1.0
        logvar = 2 * math.log(std or 1.0)
        for t, v in at.items():
            want[s, t, node, m] = None if v is None else round((mean - v) ** 2 / math.exp(logvar) + logvar, 6)
    got = {(r.series_id, r.t, r.node, r.metric): r.error for r in cells.collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(got) == cells.count()
