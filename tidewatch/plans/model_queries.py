"""Registered queries: feature selection, reconstruction models, graphs, run and trial comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions import losses
from tidewatch.operators import compare, evaluate, graph, prepare, reconstruct, scoring, select, selection, spread, windows
from tidewatch.plans import detectors, tables
from tidewatch.plans.detect_queries import CALIBRATED, calibrated
from tidewatch.plans.registry import query
from tidewatch.plans.tables import BY, KINDS, SHORT, sql, table
from tidewatch.sources import sinks

LAGS = 4


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- feature selection ----------------------------------------------------------------

DIFFS = (
    "df AS (SELECT series_id, t - 1 AS t, "
    + ", ".join(f"{k} - lag({k}) OVER w AS {k}" for k in KINDS)
    + " FROM d3 WINDOW w AS (PARTITION BY series_id ORDER BY t) QUALIFY t > 0),\ndl AS ("
    + " UNION ALL ".join(f"SELECT series_id, t, '{k}' AS f, {k} AS x FROM df" for k in KINDS)
    + """),
dm AS (SELECT series_id, max(t) + 1 AS n FROM df GROUP BY 1),
dt AS (SELECT series_id, n, tau FROM dm, range(5) r(tau) WHERE tau <= n // 2),
ra AS (SELECT series_id, tau, t, f, rank() OVER (PARTITION BY series_id, tau, f ORDER BY x)
  + (count(*) OVER (PARTITION BY series_id, tau, f, x) - 1) / 2 AS r FROM dl JOIN dt USING (series_id) WHERE t < n - tau),
rb AS (SELECT series_id, tau, t - tau AS t, f, rank() OVER (PARTITION BY series_id, tau, f ORDER BY x)
  + (count(*) OVER (PARTITION BY series_id, tau, f, x) - 1) / 2 AS r FROM dl JOIN dt USING (series_id) WHERE t >= tau),
rh AS (SELECT a.series_id, tau, a.f AS fi, b.f AS fj, corr(a.r, b.r) AS rho FROM ra a JOIN rb b USING (series_id, tau, t)
  WHERE a.f <> b.f GROUP BY ALL),
rs AS (SELECT series_id, fi, fj, max(CASE WHEN rho IS NULL OR isnan(rho) THEN 0 ELSE abs(rho) * exp(-tau / 10.0::DOUBLE) END) AS s FROM rh GROUP BY 1, 2, 3)"""
)


def similarity(spark, folder):
    return select.lagged_spearman(tables.full_day_panel(spark, folder), BY, KINDS, LAGS, decay=10.0)


@query(
    "lagged_spearman",
    sql(
        "d3",
        DIFFS + """ SELECT a.series_id, a.fi AS feature_i, a.fj AS feature_j, round(greatest(a.s, b.s), 6) AS sim
        FROM rs a JOIN rs b ON b.series_id = a.series_id AND b.fi = a.fj AND b.fj = a.fi""",
    ),
)
def _(spark, folder):
    return rounded(similarity(spark, folder), ["sim"])


# Average linkage of five features, one merge a step: d has the distances of all pairs (25 of them), w the
# sizes and lab the first member of each feature's cluster.
LINKAGE = (
    DIFFS
    + """,
sm AS (SELECT a.series_id, a.fi, a.fj, greatest(a.s, b.s) AS s FROM rs a JOIN rs b ON b.series_id = a.series_id AND b.fi = a.fj AND b.fj = a.fi),
ft AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{k}', {i})" for i, k in enumerate(KINDS))
    + """) v(f, i)),
cl AS (SELECT u.series_id, x.i * 5 + y.i AS pos, CASE WHEN x.i = y.i THEN 1e9 ELSE least(greatest(1 - coalesce(sm.s, 0), 0), 1) END AS d
  FROM (SELECT DISTINCT series_id FROM sm) u CROSS JOIN ft x CROSS JOIN ft y
  LEFT JOIN sm ON sm.series_id = u.series_id AND sm.fi = x.f AND sm.fj = y.f),
st AS (
  SELECT series_id, 0 AS k, list(d::DOUBLE ORDER BY pos) AS d, [1::DOUBLE, 1, 1, 1, 1] AS w, [0::BIGINT, 1, 2, 3, 4] AS lab FROM cl GROUP BY 1
  UNION ALL
  SELECT series_id, k + 1, list_transform(range(25), lambda x: CASE WHEN x // 5 = x % 5 OR x // 5 = j OR x % 5 = j THEN 1e9::DOUBLE
      WHEN x // 5 = i THEN (w[i + 1] * d[i * 5 + x % 5 + 1] + w[j + 1] * d[j * 5 + x % 5 + 1]) / (w[i + 1] + w[j + 1])
      WHEN x % 5 = i THEN (w[i + 1] * d[i * 5 + x // 5 + 1] + w[j + 1] * d[j * 5 + x // 5 + 1]) / (w[i + 1] + w[j + 1]) ELSE d[x + 1] END),
    list_transform(range(5), lambda x: CASE WHEN x = i THEN w[i + 1] + w[j + 1] ELSE w[x + 1] END),
    list_transform(lab, lambda l: CASE WHEN l = j THEN i ELSE l END)
  FROM (SELECT *, (m // 5)::BIGINT AS i, (m % 5)::BIGINT AS j FROM (SELECT *, list_position(d, list_min(d)) - 1 AS m FROM st WHERE list_min(d) <= 0.5))),
fin AS (SELECT series_id, lab FROM st QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY k DESC) = 1),
mb AS (SELECT series_id, f AS feature, i, lab[i + 1] AS l FROM fin CROSS JOIN ft),
sp AS (SELECT a.series_id, a.feature, a.i, a.l, round(coalesce(sum(cl.d) FILTER (WHERE b.i <> a.i), 0), 12) AS far FROM mb a
  JOIN mb b ON b.series_id = a.series_id AND b.l = a.l JOIN cl ON cl.series_id = a.series_id AND cl.pos = a.i * 5 + b.i GROUP BY ALL),
ck AS (SELECT series_id, feature, CAST(dense_rank() OVER (PARTITION BY series_id ORDER BY l) AS INTEGER) AS cluster,
  first_value(feature) OVER (PARTITION BY series_id, l ORDER BY far, i) AS medoid FROM sp)"""
)


@query("cluster_redundant", sql("d3", LINKAGE + " SELECT * FROM ck").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, folder):
    return select.cluster_redundant(similarity(spark, folder), BY, KINDS, corr_threshold=0.5)


@query("select_chain")
def _(spark, folder):
    """All stages on the day panel, where a user has the event types that ever occurred."""
    raw = tables.day_panel(spark, folder)
    days = spread.durable(prepare.interpolate(raw, BY, KINDS))
    groups = spread.durable(selection.select_features(days, BY, KINDS, SHORT, LAGS, decay=10.0))
    own = selection.own_features(days, BY, KINDS).where("verdict <> 'dropped'")
    wrong = select.check_partition(groups, own.select(*BY, "feature"), BY)
    # Features that no group or two groups hold would follow with their problem: there are none.
    return groups.unionByName(wrong.select(*BY, "feature", F.lit(-1).alias("grp"), F.col("problem").alias("kind")))


MEMBERS = {"click": 1, "error": 1, "purchase": 2, "signup": 3, "view": 3}
MEMBER_SQL = "(VALUES " + ", ".join(f"('{f}', {c})" for f, c in MEMBERS.items()) + ") m(feature, cluster)"
IMPORTANCE = (
    "im AS (SELECT series_id, feature, round(stddev_pop(x), 6) AS importance FROM ("
    + " UNION ALL ".join(f"SELECT series_id, '{k}' AS feature, {k} AS x FROM d3" for k in KINDS)
    + ") GROUP BY 1, 2)"
)
CLUSTERED = (
    IMPORTANCE
    + f""",
ci AS (SELECT series_id, cluster, min(feature) AS medoid FROM im JOIN {MEMBER_SQL} USING (feature) GROUP BY 1, 2),
cj AS (SELECT ci.series_id, cluster, medoid, importance FROM ci JOIN im ON im.series_id = ci.series_id AND im.feature = medoid)"""
)


def importance(spark, folder):
    """Spread of each feature of each user, standing in for a model's importance."""
    wide = prepare.fit_moments(tables.full_day_panel(spark, folder), BY, KINDS)
    rows = prepare.stat_rows(wide, BY, KINDS, ["std"])
    return spread.durable(rows.select("series_id", "feature", F.round("std", 6).alias("importance")))


def members(scores):
    """Fixed clusters of the five event types for every user; the first name is the medoid."""
    cluster = F.when(F.col("feature").isin("click", "error"), 1).when(F.col("feature") == "purchase", 2).otherwise(3)
    rows = scores.select("series_id", "feature", cluster.alias("cluster"))
    medoid = F.when(F.col("cluster") == 1, "click").when(F.col("cluster") == 2, "purchase").otherwise("signup")
    return rows.withColumn("medoid", medoid)


@query("join_cluster_importance", sql("d3", CLUSTERED + " SELECT * FROM cj"))
def _(spark, folder):
    scores = importance(spark, folder)
    return select.cluster_importance(members(scores), scores, BY)


GROUPS = f"""cq AS (SELECT series_id, quantile_cont(importance, 0.5) AS cut FROM cj GROUP BY 1),
ck AS (SELECT cj.*, importance >= cut AS high FROM cj JOIN cq USING (series_id)),
cn AS (SELECT series_id, cluster, high, CASE WHEN high THEN row_number() OVER (PARTITION BY series_id, high ORDER BY importance DESC, cluster) - 1
  ELSE count(*) FILTER (high) OVER (PARTITION BY series_id) END AS grp FROM ck),
gr AS (SELECT series_id, feature, CAST(grp AS INTEGER) AS grp, CASE WHEN high THEN 'important' ELSE 'catch_all' END AS kind
  FROM cn JOIN {MEMBER_SQL} USING (cluster)),
sn AS (SELECT DISTINCT series_id, 'flag' AS feature FROM im),
ga AS (SELECT * FROM gr UNION ALL SELECT sn.series_id, sn.feature, CAST(g.grp + 1 AS INTEGER), 'sentinel' FROM sn
  JOIN (SELECT series_id, max(grp) AS grp FROM gr GROUP BY 1) g USING (series_id))"""


def groups(scores, mode="auto"):
    """Groups of the fixed clusters, with one sentinel feature per user."""
    who = members(scores)
    flags = scores.select("series_id", F.lit("flag").alias("feature")).distinct()
    return select.group_modes(who, select.cluster_importance(who, scores, BY), BY, mode, 50.0, flags)


@query("assign_groups", sql("d3", CLUSTERED + ", " + GROUPS + " SELECT * FROM ga"))
def _(spark, folder):
    return groups(importance(spark, folder))


@query(
    "group_modes",
    sql(
        "d3",
        IMPORTANCE + f""" SELECT series_id, 'clusters' AS mode, feature, CAST(cluster - 1 AS INTEGER) AS grp, 'important' AS kind FROM im JOIN {MEMBER_SQL} USING (feature)
        UNION ALL SELECT DISTINCT series_id, 'clusters', 'flag', 3, 'sentinel' FROM im
        UNION ALL SELECT series_id, 'single', feature, 0, 'important' FROM im UNION ALL SELECT DISTINCT series_id, 'single', 'flag', 1, 'sentinel' FROM im""",
    ),
)
def _(spark, folder):
    scores = importance(spark, folder)
    both = [groups(scores, m).withColumn("mode", F.lit(m)) for m in ("clusters", "single")]
    return both[0].unionByName(both[1])


@query(
    "topk_features",
    sql(
        "d3",
        IMPORTANCE + """, rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY importance DESC, feature) AS rank FROM im)
        SELECT series_id, feature, importance, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= 2 THEN 'top' ELSE 'rest' END AS part FROM rk""",
    ),
)
def _(spark, folder):
    return select.top_features(importance(spark, folder), BY, 2)


@query("sort_importance", sql("d3", IMPORTANCE + " SELECT * FROM im ORDER BY series_id, importance DESC, feature"))
def _(spark, folder):
    return select.sorted_importance(importance(spark, folder), BY)


@query(
    "set_union_groups",
    sql("d3", CLUSTERED + ", " + GROUPS + " SELECT series_id, feature FROM gr UNION SELECT series_id, feature FROM im"),
)
def _(spark, folder):
    keys, scores = ["series_id", "feature"], importance(spark, folder)
    return select.union_groups(groups(scores).where("kind <> 'sentinel'").select(keys), scores.select(keys))


@query(
    "set_intersect",
    sql(
        "d3",
        CLUSTERED + ", " + GROUPS + """ SELECT series_id, feature FROM gr WHERE kind = 'important'
        INTERSECT SELECT series_id, feature FROM im WHERE importance > 10""",
    ),
)
def _(spark, folder):
    keys, scores = ["series_id", "feature"], importance(spark, folder)
    important = groups(scores).where("kind = 'important'").select(keys)
    return select.shared_features(important, scores.where("importance > 10").select(keys))


@query(
    "set_check_partition",
    sql(
        "d3",
        IMPORTANCE + """ SELECT DISTINCT series_id, 'flag' AS feature, 'extra' AS problem FROM im
        UNION ALL SELECT DISTINCT series_id, 'lost', 'missing' FROM im UNION ALL SELECT DISTINCT series_id, 'click', 'overlap' FROM im""",
    ),
)
def _(spark, folder):
    scores = importance(spark, folder)
    have = spread.durable(groups(scores))
    twice = have.where("feature = 'click'").withColumn("grp", F.lit(9))
    want = scores.select("series_id", "feature")
    lost = want.select("series_id", F.lit("lost").alias("feature"))
    return select.check_partition(have.unionByName(twice), want.unionByName(lost), BY)


@query(
    "positions_sorted",
    sql(
        "d3",
        CLUSTERED + ", " + GROUPS + """ SELECT series_id, feature, CAST(row_number() OVER (PARTITION BY series_id ORDER BY feature) - 1 AS INTEGER) AS position FROM ga""",
    ),
)
def _(spark, folder):
    return select.sorted_positions(groups(importance(spark, folder)), BY)


# ---- reconstruction -------------------------------------------------------------------


def scaled_days(spark, folder):
    """The standardised day panel, written once."""
    df = tables.stored_day_panel(spark, folder)
    return spread.durable(prepare.scale_standard(df, prepare.fit_moments(df, BY, KINDS), BY, KINDS))


def flat_windows(scaled):
    """Five-day windows, flattened."""
    return windows.flatten_windows(windows.sliding(scaled, BY, KINDS, SHORT))


@query("recon_pca")
def _(spark, folder):
    scaled = scaled_days(spark, folder)
    wins, model = flat_windows(scaled), reconstruct.WindowPca.fit_panel(scaled, BY, KINDS, SHORT, 6)
    return rounded(reconstruct.pca_errors(wins, model, ["series_id", "w", "t_end"]), ["score"])


def trend_model():
    """A given model of five-day windows of two features: the level of the first and a trend that both share."""
    basis = np.zeros((2 * SHORT, 2))
    basis[0::2, 0] = 1 / np.sqrt(SHORT)
    basis[:, 1] = np.repeat(np.arange(SHORT) - SHORT // 2, 2) / np.sqrt(20)
    return reconstruct.WindowPca(np.full(2 * SHORT, 1 / 3), basis)


@query(
    "recon_basis",
    sql(
        "d3",
        """wl AS (SELECT series_id, t - 4 AS w, t AS t_end, list(click) OVER v AS c, list(error) OVER v AS e FROM d3
        WINDOW v AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) QUALIFY t >= 4),
        wz AS (SELECT *, list_avg(c) AS m, list_sum(list_transform(c, lambda x, i: (i - 3) * (x + e[i]))) / 20 AS s FROM wl)
        SELECT series_id, w, t_end, round(list_sum(list_transform(c, lambda x, i: (x - m - (i - 3) * s) ** 2 + (e[i] - 1 / 3 - (i - 3) * s) ** 2)) / 10, 6) AS score FROM wz""",
    ),
)
def _(spark, folder):
    wins = windows.sliding(tables.full_day_panel(spark, folder), BY, ["click", "error"], SHORT)
    errors = reconstruct.pca_errors(windows.flatten_windows(wins), trend_model(), ["series_id", "w", "t_end"])
    return rounded(errors, ["score"])


TWO = {0: ["click", "error"], 1: ["purchase", "signup", "view"]}


@query("recon_grouped")
def _(spark, folder):
    scaled = scaled_days(spark, folder)
    wins = windows.sliding_grouped(scaled, BY, TWO, SHORT)
    fitted = reconstruct.GroupedPca.fit_panel(scaled, BY, TWO, SHORT, 3)
    return rounded(scoring.group_losses(fitted.transform(wins), ["series_id", "w"], {0: False, 1: False}), ["loss"])


def mean_model(batches):
    """A user's model: predicts each window's own mean."""
    import numpy as np

    for pdf in batches:
        if len(pdf):
            x = np.stack(pdf["vec"].to_numpy())
            mean = x.mean(axis=1, keepdims=True)
            yield pdf[["series_id", "w"]].assign(score=((x - mean) ** 2).mean(axis=1).round(6))


@query(
    "recon_external",
    sql(
        "e1",
        """SELECT series_id, t - 29 AS w, round(var_pop(x) OVER (PARTITION BY series_id ORDER BY t
        ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS score FROM e1 QUALIFY t >= 29""",
    ),
)
def _(spark, folder):
    wins = windows.flatten_windows(windows.sliding(tables.event_panel(spark, folder), BY, ["x"], tables.LENGTH))
    return reconstruct.external(wins.select("series_id", "w", "vec"), mean_model, "series_id bigint, w bigint, score double")


@query("mask_importance")
def _(spark, folder):
    df = tables.stored_day_panel(spark, folder)
    scaled = spread.durable(prepare.scale_robust(df, prepare.median_iqr(df, BY, KINDS), BY, KINDS))
    # Windows are numbered by their first row: the first part of them is learned from, the rest is shuffled.
    numbers = scaled.select(*BY, (F.col("t") - (SHORT - 1)).alias("w")).where("w >= 0")
    split = prepare.split_contiguous(numbers, BY, 0.3, t="w")
    cut = spread.durable(split.where("split = 'val'").groupBy(*BY).agg(F.min("w").alias("cut")))
    placed = spread.durable(spread.lookup_join(scaled, cut, BY))
    learned = placed.where(F.col("t") < F.col("cut") + SHORT - 1)
    model = reconstruct.WindowPca.fit_panel(learned, BY, KINDS, SHORT, 6)
    val = flat_windows(placed.where(F.col("t") >= F.col("cut")))
    return rounded(select.mask_importance(val, BY, KINDS, SHORT, model), ["importance"])


@query("rf_importance")
def _(spark, folder):
    df = tables.stored_day_panel(spark, folder)
    wins = windows.flatten_windows(windows.sliding(df, BY, KINDS, SHORT))
    labels = df.select("series_id", "t", (F.col("error") > 30).cast("int").alias("y"))
    known = windows.align_end(wins, labels, BY, SHORT)
    return select.top_features(
        select.forest_importance(known, KINDS).withColumn("series_id", F.lit(0)), BY, 3
    )


@query("sink_model")
def _(spark, folder):
    scaled = scaled_days(spark, folder)
    wins, path = flat_windows(scaled), sinks.scratch(spark, "model")
    sinks.save_fitted({"pca": reconstruct.WindowPca.fit_panel(scaled, BY, KINDS, SHORT, 4).to_rows(spark)}, path)
    model = reconstruct.WindowPca.from_rows(sinks.load_fitted(spark, path, ["pca"])["pca"])
    return rounded(reconstruct.pca_errors(wins, model, ["series_id", "w"]), ["score"])


@query(
    "sink_calibrated",
    sql(
        "gl ec",
        CALIBRATED.format(how="avg") + """, th AS (SELECT series_id, quantile_cont(score, 0.9) AS threshold FROM sc WHERE split = 'val' GROUP BY 1)
        SELECT series_id, w, t_end, score, round(threshold, 9) AS threshold, CAST(score > threshold AS INTEGER) AS pred FROM sc JOIN th USING (series_id)""",
    ),
)
def _(spark, folder):
    fitted, steps = calibrated(spark, folder)
    path = sinks.scratch(spark, "calibrated")
    parts = {"ecdf": fitted.ecdf, "held_out": fitted.held_out, "thresholds": fitted.thresholds}
    sinks.save_fitted(parts, path)
    again = detectors.FittedCalibrated(fitted.detector, **sinks.load_fitted(spark, path, list(parts)))
    return rounded(again.transform(steps), ["threshold"], 9)


# ---- estimators and grids -------------------------------------------------------------


@query(
    "api_estimator",
    sql("e1 s1 fl", "SELECT series_id, w, t_end, score, round(threshold, 9) AS threshold, pred FROM fl"),
)
def _(spark, folder):
    detector = detectors.WindowDetector(BY, ["x"], tables.LENGTH, percentile=95.0, digits=6)
    panel = tables.event_panel(spark, folder)
    return rounded(detector.fit(panel).transform(panel), ["threshold"], 9)


@query(
    "api_corrupt",
    sql("d3", """SELECT series_id, round(sum((click - error) * (click - error)) / count(*), 4) AS mse FROM d3 GROUP BY 1"""),
)
def _(spark, folder):
    df = tables.full_day_panel(spark, folder).select("series_id", F.array("click").alias("x"), F.array("error").alias("other"))
    worse = detectors.corrupted_mse(df, BY, "x", lambda x: F.col("other"))
    return rounded(worse.select("series_id", "mse"), ["mse"], 4)


@query(
    "api_predictor",
    sql("e1", "SELECT series_id, t, round(2 * x + k, 6) AS score FROM e1"),
)
def _(spark, folder):
    def double(batches, weights):
        for pdf in batches:
            yield pdf[["series_id", "t"]].assign(score=(weights["x"] * pdf["x"] + weights["k"] * pdf["k"]).round(6))

    df = tables.event_panel(spark, folder).select("series_id", "t", "x", "k")
    return reconstruct.external(df, double, "series_id bigint, t bigint, score double", {"x": 2.0, "k": 1.0})


@query("api_run_grid")
def _(spark, folder):
    panel = tables.stored_day_panel(spark, folder)
    labels = panel.select("series_id", "t", (F.col("error") > 30).cast("int").alias("y"))
    variants = {
        "window_mean": lambda seed: detectors.WindowDetector(BY, KINDS, SHORT),
        "pca_2": lambda seed: detectors.PcaDetector(BY, KINDS, SHORT, k=2),
        "pca_6": lambda seed: detectors.PcaDetector(BY, KINDS, SHORT, k=6),
    }
    runs = detectors.run_grid(panel, labels, BY, variants, seeds=[0], length=SHORT)
    return rounded(runs, ["f1", "aucpr", "auroc", "score_sep"])


@query(
    "api_objective",
    sql(
        "e1 s1",
        "tr2 AS (SELECT s1.*, e1.y FROM s1 JOIN e1 ON e1.series_id = s1.series_id AND e1.t = s1.t_end),\nth2 AS ("
        + " UNION ALL ".join(
            f"SELECT {i} AS trial, series_id, quantile_cont(score, {p / 100}) AS cut FROM s1 GROUP BY 2"
            for i, p in enumerate((85, 90, 95))
        )
        + """), cf AS (SELECT trial, count(*) FILTER (score > cut AND y = 1) AS tp, count(*) FILTER (score > cut AND y = 0) AS fp,
        count(*) FILTER (score <= cut AND y = 1) AS fn FROM tr2 JOIN th2 USING (series_id) GROUP BY 1)
        SELECT 'percentile' AS study, CAST(trial AS BIGINT) AS trial, 'COMPLETE' AS state, round(2 * tp / (2 * tp + fp + fn), 6) AS value FROM cf""",
    ),
)
def _(spark, folder):
    panel = tables.event_panel(spark, folder)
    scored = tables.window_scores(spark, folder)

    def objective(params):
        flags = scoring.flag(scored, scoring.fit_threshold(scored, BY, params["percentile"]), BY)
        return evaluate.f1(windows.align_end(flags, panel, BY, tables.LENGTH), [])

    trials = detectors.grid_trials(spark, "percentile", objective, [{"percentile": float(p)} for p in (85, 90, 95)])
    return rounded(trials.drop("params"), ["value"])


# ---- graphs ---------------------------------------------------------------------------

EDGES = """ed AS (SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name),
gn AS (SELECT l_returnflag AS series_id, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS BIGINT) AS t, n_name AS node, 'qty' AS metric,
  sum(l_quantity) AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3)"""
GRAPH_KEYS = ["series_id", "t", "metric"]


def edge_table(spark, folder):
    """Nations of one region; the nation table has a fixed size."""
    nation = table(spark, folder, "nation")
    other = nation.select(F.col("n_name").alias("dst"), "n_regionkey")
    return nation.join(other, "n_regionkey").where("n_name <> dst").select(F.col("n_name").alias("src"), "dst")


def nation_panel(spark, folder):
    nation = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    supplier = table(spark, folder, "supplier").join(nation, "s_nationkey").withColumnRenamed("s_suppkey", "l_suppkey")
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("bigint")
    per_supplier = table(spark, folder, "lineitem").groupBy(
        F.col("l_returnflag").alias("series_id"), month.alias("t"), "l_suppkey"
    ).agg(F.sum("l_quantity").alias("q"))
    joined = per_supplier.join(supplier.select("l_suppkey", "n_name"), "l_suppkey")
    return joined.groupBy("series_id", "t", F.col("n_name").alias("node"), F.lit("qty").alias("metric")).agg(F.sum("q").alias("x"))


def node_names(spark, folder):
    return table(spark, folder, "nation").select(F.col("n_name").alias("node"))


@query("src_edges", f"WITH {EDGES} SELECT src, dst FROM ed")
def _(spark, folder):
    from tidewatch.sources import readers

    path = sinks.scratch(spark, "edges")
    edge_table(spark, folder).write.csv(path, header=True)
    return readers.edges(spark, path)


@query("join_graph_neighbours", f"WITH {EDGES} SELECT series_id, t, node AS src, metric, x, dst FROM gn JOIN ed ON ed.src = gn.node")
def _(spark, folder):
    return graph.neighbours(nation_panel(spark, folder), edge_table(spark, folder))


@query(
    "graph_neighbour_mean",
    f"WITH {EDGES} SELECT series_id, t, metric, dst AS node, round(avg(x), 6) AS neighbour_mean FROM gn JOIN ed ON ed.src = gn.node GROUP BY ALL",
)
def _(spark, folder):
    means = graph.neighbour_mean(nation_panel(spark, folder), edge_table(spark, folder), GRAPH_KEYS)
    return rounded(means, ["neighbour_mean"])


WEIGHTS = """wt AS (SELECT src, dst, 1.0::DOUBLE AS w FROM ed UNION ALL SELECT n_name, n_name, 2 FROM nation),
dg AS (SELECT dst AS node, sum(w) AS d FROM wt GROUP BY 1),
wn AS (SELECT src, dst, w / sqrt(a.d * b.d) AS w FROM wt JOIN dg a ON a.node = src JOIN dg b ON b.node = dst)"""


@query(
    "graph_gcn_smooth",
    f"WITH {EDGES}, {WEIGHTS} SELECT series_id, t, metric, dst AS node, round(sum(w * x), 6) AS smoothed FROM gn JOIN wn ON wn.src = gn.node GROUP BY ALL",
)
def _(spark, folder):
    out = graph.smooth(nation_panel(spark, folder), edge_table(spark, folder), node_names(spark, folder), GRAPH_KEYS)
    return rounded(out, ["smoothed"])


@query(
    "graph_residual",
    f"""WITH {EDGES}, nm AS (SELECT series_id, t, dst AS node, avg(x) AS m FROM gn JOIN ed ON ed.src = gn.node GROUP BY ALL)
    SELECT gn.series_id, gn.t, gn.node, metric, x, round(x - m, 6) AS residual FROM gn
    LEFT JOIN nm ON nm.series_id = gn.series_id AND nm.t = gn.t AND nm.node = gn.node""",
)
def _(spark, folder):
    return rounded(graph.residual(nation_panel(spark, folder), edge_table(spark, folder), GRAPH_KEYS), ["residual"])


# ---- runs and trials ------------------------------------------------------------------

RUNS = """ru AS (SELECT o_orderkey % 5 AS seed, CASE WHEN o_orderpriority = '1-URGENT' THEN 'none' ELSE o_orderpriority END AS variant,
  o_orderstatus AS type, round(avg(o_totalprice) / 600000, 8) AS aucpr, round(stddev_pop(o_totalprice) / 600000, 8) AS f1 FROM orders GROUP BY 1, 2, 3)"""


def runs(spark, folder):
    """One run per order-key residue, priority and status, with averages standing in for metrics."""
    variant = F.when(F.col("o_orderpriority") == "1-URGENT", "none").otherwise(F.col("o_orderpriority"))
    return (
        table(spark, folder, "orders")
        .groupBy((F.col("o_orderkey") % 5).alias("seed"), variant.alias("variant"), F.col("o_orderstatus").alias("type"))
        .agg(
            F.round(F.avg("o_totalprice") / 600000, 8).alias("aucpr"),
            F.round(F.stddev_pop("o_totalprice") / 600000, 8).alias("f1"),
        )
    )


@query(
    "agg_variant_summary",
    f"""WITH {RUNS} SELECT variant, type, round(avg(aucpr), 6) AS mean_aucpr, round(avg(f1), 6) AS mean_f1,
    round(stddev_pop(aucpr), 6) AS std_aucpr, round(stddev_pop(f1), 6) AS std_f1 FROM ru GROUP BY 1, 2""",
)
def _(spark, folder):
    out = compare.variant_summary(runs(spark, folder), ["variant", "type"], ["aucpr", "f1"])
    return rounded(out, ["mean_aucpr", "mean_f1", "std_aucpr", "std_f1"])


PAIRS = """pa AS (SELECT c.seed, c.type, c.variant, c.aucpr, b.aucpr AS base FROM ru c JOIN ru b
  ON b.seed = c.seed AND b.type = c.type AND b.variant = 'none' WHERE c.variant <> 'none')"""


@query("join_variant_baseline", f"WITH {RUNS}, {PAIRS} SELECT * FROM pa")
def _(spark, folder):
    return compare.against_baseline(runs(spark, folder), ["seed", "type"], "aucpr")


@query("agg_win_counts", f"WITH {RUNS}, {PAIRS} SELECT variant, type, count(*) FILTER (aucpr > base) AS wins, count(*) AS n FROM pa GROUP BY 1, 2")
def _(spark, folder):
    return compare.win_counts(runs(spark, folder), ["seed", "type"], ["variant", "type"], "aucpr")


@query(
    "agg_acceptance",
    f"""WITH {RUNS}, ps AS (SELECT seed, variant, avg(aucpr) FILTER (type IN ('F', 'O')) AS hard, avg(aucpr) FILTER (type = 'P') AS control FROM ru GROUP BY 1, 2)
    SELECT c.variant, count(*) FILTER (c.hard > b.hard) AS hard_wins, count(*) AS n_seeds, round(avg(c.control - b.control), 6) AS control_delta_mean,
    round(stddev_pop(c.control - b.control), 6) AS control_delta_std FROM ps c JOIN ps b ON b.seed = c.seed AND b.variant = 'none'
    WHERE c.variant <> 'none' GROUP BY 1""",
)
def _(spark, folder):
    out = compare.acceptance(runs(spark, folder), "aucpr", ["F", "O"], ["P"])
    return rounded(out, ["control_delta_mean", "control_delta_std"])


TRIALS = """ti AS (SELECT o_orderpriority AS study, o_orderkey AS trial, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'P' THEN 'PRUNED' ELSE 'FAIL' END AS state,
  o_totalprice / 1000000 AS value, CASE WHEN o_custkey % 2 = 0 THEN round(o_custkey / 1000, 6) END AS kl FROM orders)"""


def trials(spark, folder):
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "P", "PRUNED").otherwise("FAIL")
    weight = F.create_map(F.lit("kl_weight"), F.round(F.col("o_custkey") / 1000, 6))
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("study"),
        F.col("o_orderkey").alias("trial"),
        state.alias("state"),
        (F.col("o_totalprice") / 1000000).alias("value"),
        F.when(F.col("o_custkey") % 2 == 0, weight).otherwise(F.create_map().cast("map<string,double>")).alias("params"),
    )


@query(
    "agg_trial_stats",
    f"""WITH {TRIALS} SELECT study, count(*) AS n_trials, count(*) FILTER (state = 'COMPLETE') AS n_completed, count(*) FILTER (state = 'PRUNED') AS n_pruned,
    max(value) FILTER (state = 'COMPLETE') AS best, round(avg(value) FILTER (state = 'COMPLETE'), 6) AS mean,
    round(stddev_pop(value) FILTER (state = 'COMPLETE'), 6) AS std, round(quantile_cont(value, 0.5) FILTER (state = 'COMPLETE'), 9) AS median FROM ti GROUP BY 1""",
)
def _(spark, folder):
    out = compare.trial_stats(trials(spark, folder))
    return rounded(rounded(out, ["mean", "std"]), ["median"], 9)


@query(
    "agg_param_corr",
    f"WITH {TRIALS} SELECT study, round(corr(coalesce(kl, 0.1), value), 6) AS corr FROM ti WHERE state = 'COMPLETE' GROUP BY 1",
)
def _(spark, folder):
    return rounded(compare.param_correlation(trials(spark, folder)), ["corr"])


@query(
    "best_trial",
    f"""WITH {TRIALS} SELECT study, arg_max(trial, (value, -trial)) AS trial, max(value) AS value, coalesce(arg_max(coalesce(kl, -1), (value, -trial)), -1) AS kl_weight
    FROM ti WHERE state = 'COMPLETE' GROUP BY 1""",
)
def _(spark, folder):
    best = compare.best_trial(trials(spark, folder))
    weight = F.coalesce(F.try_element_at("params", F.lit("kl_weight")), F.lit(-1.0))
    return best.select("study", "trial", "value", weight.alias("kl_weight"))


@query(
    "win_running_best",
    f"""WITH {TRIALS} SELECT study, trial, value, greatest(0, max(value) OVER (PARTITION BY study ORDER BY trial)) AS best
    FROM ti WHERE state = 'COMPLETE'""",
)
def _(spark, folder):
    return compare.running_best(trials(spark, folder))


@query(
    "sink_trials",
    f"WITH {TRIALS} SELECT study, trial, state, value, coalesce(kl, -1) AS kl_weight FROM ti",
)
def _(spark, folder):
    path = sinks.scratch(spark, "trials")
    everything = trials(spark, folder)
    for part in ("COMPLETE", "PRUNED", "FAIL"):
        sinks.append_trials(everything.where(F.col("state") == part), path)
    weight = F.coalesce(F.try_element_at("params", F.lit("kl_weight")), F.lit(-1.0))
    return sinks.load_trials(spark, path).select("study", "trial", "state", "value", weight.alias("kl_weight"))
