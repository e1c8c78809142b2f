"""Registered queries: losses, calibration, thresholds, label alignment and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import losses
from tidewatch.operators import evaluate, panel, prepare, scoring, spread, windows
from tidewatch.plans import detectors, tables
from tidewatch.plans.registry import query
from tidewatch.plans.tables import BY, LENGTH, SHORT, WIDTH, sql, table

PRF = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
PRF_OF = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall"""
F1_OF = "CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1"


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def lengths(spark, folder):
    return tables.series_sizes(spark, folder).groupBy("series_id").agg(F.count("*").alias("n"))


# ---- losses ---------------------------------------------------------------------------


def vector_pairs(spark, folder):
    """x = an embedding, xhat = the same values in reverse order."""
    v = F.transform("embedding", lambda a: a.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", v.alias("x"), F.reverse(v).alias("xhat"))


PAIR_SQL = """ep AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x, CAST(embedding[65 - i] AS DOUBLE) AS z
  FROM embeddings, range(1, 65) r(i))"""


@query(
    "loss_mse",
    f"WITH {PAIR_SQL} SELECT vec_id, round(avg((z - x) * (z - x)), 6) AS mean_loss, round(sum((z - x) * (z - x)), 6) AS sum_loss "
    "FROM ep GROUP BY 1",
)
def _(spark, folder):
    x, xhat = F.col("x"), F.col("xhat")
    return vector_pairs(spark, folder).select(
        "vec_id",
        F.round(losses.mse(x, xhat), 6).alias("mean_loss"),
        F.round(losses.mse(x, xhat, "sum"), 6).alias("sum_loss"),
    )


@query(
    "loss_bce",
    f"WITH {PAIR_SQL} SELECT vec_id, round(avg(greatest(z, 0) - z * (x > 0)::INT + ln(1 + exp(-abs(z)))), 6) AS loss FROM ep GROUP BY 1",
)
def _(spark, folder):
    bits = F.transform("x", lambda a: (a > 0).cast("double"))
    return vector_pairs(spark, folder).select(
        "vec_id", F.round(losses.bce_with_logits(bits, F.col("xhat")), 6).alias("loss")
    )


@query(
    "loss_kl",
    f"""WITH {PAIR_SQL} SELECT vec_id, round(-0.5 * avg(1 + z - x * x - exp(z)), 6) AS mean_loss,
    round(-0.5 * sum(1 + z - x * x - exp(z)), 6) AS sum_loss FROM ep GROUP BY 1""",
)
def _(spark, folder):
    mu, logvar = F.col("x"), F.col("xhat")
    return vector_pairs(spark, folder).select(
        "vec_id",
        F.round(losses.kl_divergence(mu, logvar), 6).alias("mean_loss"),
        F.round(losses.kl_divergence(mu, logvar, "sum"), 6).alias("sum_loss"),
    )


@query(
    "loss_gaussian",
    sql(
        "d3",
        """SELECT series_id, t, round((error - click) * (error - click) / exp(signup / 100) + signup / 100, 6) AS loss FROM d3""",
    ),
)
def _(spark, folder):
    loss = losses.gaussian_nll(F.col("click"), F.col("error"), F.col("signup") / 100)
    return tables.full_day_panel(spark, folder).select("series_id", "t", F.round(loss, 6).alias("loss"))


@query(
    "loss_per_group",
    f"""WITH {PAIR_SQL} SELECT vec_id, CASE WHEN i <= 32 THEN 0 ELSE 1 END AS grp,
    round(avg(CASE WHEN i <= 32 THEN (z - x) * (z - x) ELSE greatest(z, 0) - z * (x > 0)::INT + ln(1 + exp(-abs(z))) END), 6) AS loss
    FROM ep GROUP BY 1, 2""",
)
def _(spark, folder):
    half = WIDTH // 2
    pairs = vector_pairs(spark, folder).select(
        "vec_id",
        F.slice("x", 1, half).alias("x_0"),
        F.slice("xhat", 1, half).alias("xhat_0"),
        F.transform(F.slice("x", half + 1, half), lambda a: (a > 0).cast("double")).alias("x_1"),
        F.slice("xhat", half + 1, half).alias("xhat_1"),
    )
    return rounded(scoring.group_losses(pairs, ["vec_id"], {0: False, 1: True}), ["loss"])


@query("recon_window_mean", sql("e1 s1", "SELECT * FROM s1"))
def _(spark, folder):
    return tables.window_scores(spark, folder)


@query(
    "score_weighted",
    sql(
        "gl",
        """SELECT series_id, w, round(sum(CASE WHEN grp = 0 THEN 0.7 ELSE 0.3 END::DOUBLE * loss)
        + CAST(0.01 AS DOUBLE) * max(w), 8) AS score FROM gl GROUP BY 1, 2""",
    ),
)
def _(spark, folder):
    per_group = tables.group_window_losses(spark, folder)
    return rounded(scoring.weighted_score(per_group, ["series_id", "w"], {0: 7.0, 1: 3.0}, "w", 0.01), ["score"], 8)


@query(
    "agg_global_mse",
    f"WITH {PAIR_SQL} SELECT label, round(sum((z - x) * (z - x)), 6) AS sse, count(*) AS n_elements, "
    "round(avg((z - x) * (z - x)), 6) AS mse FROM ep JOIN embeddings USING (vec_id) GROUP BY 1",
)
def _(spark, folder):
    v = F.transform("embedding", lambda a: a.cast("double"))
    pairs = table(spark, folder, "embeddings").select("label", v.alias("x"), F.reverse(v).alias("xhat"))
    return rounded(evaluate.global_mse(pairs, ["label"], F.col("x"), F.col("xhat")), ["sse", "mse"])


# ---- calibration and thresholds -------------------------------------------------------


@query(
    "agg_trim_quantile",
    sql("gl ec", "SELECT series_id, w, grp, loss FROM gl JOIN eq USING (series_id, grp) WHERE split = 'train' AND loss >= lo AND loss <= hi"),
)
def _(spark, folder):
    train = tables.group_window_losses(spark, folder).where("split = 'train'").drop("split")
    return scoring.trim(train, ["series_id", "grp"], "loss", bound_by=group_sizes(spark, folder))


def group_sizes(spark, folder):
    return tables.series_sizes(spark, folder).withColumn("grp", F.lit(0))


def baseline_ecdf(spark, folder, losses_of):
    train = losses_of.where("split = 'train'")
    return spread.durable(scoring.fit_ecdf(train, ["series_id", "grp"], bound_by=group_sizes(spark, folder)))


@query(
    "fit_ecdf",
    sql("gl ec", "SELECT series_id, grp, loss, n, CAST(sum(n) OVER (PARTITION BY series_id, grp ORDER BY loss) AS BIGINT) AS cum FROM ec"),
)
def _(spark, folder):
    return scoring.cumulative(
        baseline_ecdf(spark, folder, tables.group_window_losses(spark, folder)), ["series_id", "grp"]
    )


BELOW = """bl AS (SELECT g.series_id, g.w, g.grp, g.loss, CAST(coalesce(sum(e.n) FILTER (e.loss <= g.loss), 0) AS BIGINT) AS below,
  CAST(sum(e.n) AS BIGINT) AS n_base FROM gl g JOIN ec e USING (series_id, grp) WHERE g.split = 'val' GROUP BY 1, 2, 3, 4)"""


@query("join_ecdf_asof", sql("gl ec", BELOW + " SELECT * FROM bl"))
def _(spark, folder):
    losses_of = tables.group_window_losses(spark, folder)
    val, ecdf = losses_of.where("split = 'val'"), baseline_ecdf(spark, folder, losses_of)
    return scoring.count_below(val, ecdf, ["series_id", "grp"], ["w"], bound_by=group_sizes(spark, folder)).select(
        "series_id", "w", "grp", "loss", "below", "n_base"
    )


@query(
    "score_ecdf",
    sql(
        "gl ec",
        BELOW + """, tl AS (SELECT series_id, w, -ln(2 * least(below / n_base, 1 - below / n_base) + CAST(1e-12 AS DOUBLE)) AS s FROM bl)
        SELECT series_id, w, round(avg(s), 6) AS mean_score, round(max(s), 6) AS max_score FROM tl GROUP BY 1, 2""",
    ),
)
def _(spark, folder):
    losses_of, sizes = tables.group_window_losses(spark, folder), group_sizes(spark, folder)
    val, ecdf = losses_of.where("split = 'val'"), baseline_ecdf(spark, folder, losses_of)
    below = scoring.count_below(val, ecdf, ["series_id", "grp"], ["w"], bound_by=sizes)
    tail = losses.tail_score(F.col("below"), F.col("n_base"))
    return below.groupBy("series_id", "w").agg(
        F.round(F.avg(tail), 6).alias("mean_score"), F.round(F.max(tail), 6).alias("max_score")
    )


CALIBRATED = """ab AS (SELECT g.series_id, g.w, g.grp, g.split, CAST(coalesce(sum(e.n) FILTER (e.loss <= g.loss), 0) AS BIGINT) AS below,
  CAST(sum(e.n) AS BIGINT) AS n_base FROM gl g JOIN ec e USING (series_id, grp) GROUP BY g.series_id, g.w, g.grp, g.split, g.loss),
sc AS (SELECT series_id, w, w + 29 AS t_end, any_value(split) AS split,
  round({how}(-ln(2 * least(below / n_base, 1 - below / n_base) + CAST(1e-12 AS DOUBLE))), 6) AS score FROM ab GROUP BY 1, 2)"""


def calibrated(spark, folder, combine="mean"):
    detector = detectors.CalibratedDetector(BY, {0: ["x"], 1: ["k"]}, LENGTH, 90.0, combine, digits=6)
    steps = tables.event_panel(spark, folder)
    return detector.fit(steps), steps


@query(
    "detect_calibrated",
    sql(
        "gl ec",
        CALIBRATED.format(how="avg") + """, th AS (SELECT series_id, quantile_cont(score, 0.9) AS threshold FROM sc WHERE split = 'val' GROUP BY 1)
        SELECT series_id, w, t_end, score, round(threshold, 9) AS threshold, CAST(score > threshold AS INTEGER) AS pred FROM sc JOIN th USING (series_id)""",
    ),
)
def _(spark, folder):
    fitted, steps = calibrated(spark, folder)
    return rounded(fitted.transform(steps), ["threshold"], 9)


@query(
    "detect_calibrated_report",
    sql(
        "gl ec",
        CALIBRATED.format(how="max") + f""", th AS (SELECT series_id, quantile_cont(score, 0.9) AS threshold FROM sc WHERE split = 'val' GROUP BY 1),
        ty AS (SELECT CAST(sc.score > threshold AS INTEGER) AS pred, e1.y FROM sc JOIN th USING (series_id)
          JOIN e1 ON e1.series_id = sc.series_id AND e1.t = sc.t_end),
        cf AS (SELECT count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp,
          count(*) FILTER (pred = 0 AND y = 1) AS fn, count(*) FILTER (pred = 0 AND y = 0) AS tn FROM ty),
        pr AS (SELECT *, {PRF_OF} FROM cf), ff AS (SELECT *, {F1_OF} FROM pr)
        SELECT tp, fp, fn, tn, {PRF} FROM ff""",
    ),
)
def _(spark, folder):
    fitted, steps = calibrated(spark, folder, "max")
    out = fitted.report(steps, steps.select("series_id", "t", "y"))
    return rounded(out, ["precision", "recall", "f1"]).select("tp", "fp", "fn", "tn", "precision", "recall", "f1")


@query(
    "detect_calibrated_sweep",
    sql(
        "gl ec",
        CALIBRATED.format(how="avg") + f""", qs AS (SELECT series_id, p AS pct, list_extract(quantile_cont(score, [0.8, 0.9, 0.95]), CASE p WHEN 80 THEN 1 WHEN 90 THEN 2 ELSE 3 END) AS threshold
          FROM (SELECT * FROM sc WHERE split = 'val'), (SELECT unnest([80, 90, 95]) AS p) GROUP BY series_id, p),
        ty AS (SELECT sc.series_id, sc.score, e1.y FROM sc JOIN e1 ON e1.series_id = sc.series_id AND e1.t = sc.t_end),
        cf AS (SELECT series_id, pct, qs.threshold, count(*) FILTER (score > qs.threshold) AS n_detected,
          count(*) FILTER (score > qs.threshold AND y = 1) AS tp, count(*) FILTER (score > qs.threshold AND y = 0) AS fp,
          count(*) FILTER (score <= qs.threshold AND y = 1) AS fn FROM ty JOIN qs USING (series_id) GROUP BY 1, 2, 3),
        pr AS (SELECT *, {PRF_OF} FROM cf), ff AS (SELECT *, {F1_OF} FROM pr)
        SELECT series_id, CAST(pct AS INTEGER) AS pct, round(threshold, 9) AS threshold, n_detected, tp, fp, fn, {PRF} FROM ff""",
    ),
)
def _(spark, folder):
    fitted, steps = calibrated(spark, folder)
    out = fitted.sweep(steps, steps.select("series_id", "t", "y"), [80, 90, 95])
    return rounded(rounded(out, ["threshold"], 9), ["precision", "recall", "f1"])


@query("fit_threshold", sql("e1 s1 fl", "SELECT series_id, round(threshold, 9) AS threshold FROM th"))
def _(spark, folder):
    cut = scoring.fit_threshold(
        tables.window_scores(spark, folder), BY, 95.0, bound_by=tables.series_sizes(spark, folder)
    )
    return rounded(cut, ["threshold"], 9)


@query(
    "flag_scores",
    sql("e1 s1 fl", "SELECT series_id, w, t_end, score, round(threshold, 9) AS threshold, pred FROM fl"),
)
def _(spark, folder):
    return rounded(tables.window_flags(spark, folder), ["threshold"], 9)


# ---- label alignment ------------------------------------------------------------------


@query("align_labels_end", sql("e1 s1 fl tr", "SELECT series_id, w, pred, y FROM tr"))
def _(spark, folder):
    flags = tables.window_flags(spark, folder).select("series_id", "w", "pred")
    return windows.align_end(flags, tables.event_panel(spark, folder), BY, LENGTH)


@query(
    "align_labels_start",
    sql(
        "e1 s1 fl",
        "SELECT e1.series_id, e1.t, e1.y, coalesce(pred, 0) AS pred FROM e1 LEFT JOIN fl ON fl.series_id = e1.series_id AND fl.w = e1.t",
    ),
)
def _(spark, folder):
    labels = tables.event_panel(spark, folder).select("series_id", "t", "y")
    return windows.align_start(tables.window_flags(spark, folder), labels, BY).select("series_id", "t", "y", "pred")


NODE_TH = """nt AS (SELECT series_id, quantile_cont(x, 0.95) AS threshold FROM nl WHERE metric = 'qty' GROUP BY 1),
np AS (SELECT series_id, t, max(CAST(x > threshold AS INTEGER)) AS pred FROM nl JOIN nt USING (series_id)
  WHERE metric = 'qty' GROUP BY 1, 2),
ny AS (SELECT series_id, t, CAST(sum(x) > 30 AS INTEGER) AS y FROM nl WHERE metric = 'disc' GROUP BY 1, 2)"""


@query("align_labels_any", sql("nl", NODE_TH + " SELECT series_id, t, pred, y FROM np JOIN ny USING (series_id, t)"))
def _(spark, folder):
    nodes = tables.node_panel(spark, folder)
    cells = nodes.where("metric = 'qty'").select("series_id", "t", "node", F.col("x").alias("score"))
    flags = scoring.flag(cells, scoring.fit_threshold(cells, BY, 95.0), BY)
    labels = (
        nodes.where("metric = 'disc'").groupBy("series_id", "t").agg((F.sum("x") > 30).cast("int").alias("y"))
    )
    return windows.align_any(flags, labels, BY)


@query(
    "pad_or_truncate_labels",
    sql(
        "e1",
        """ln AS (SELECT series_id, count(*) + CASE WHEN series_id % 2 = 0 THEN 5 ELSE -5 END AS n FROM e1 GROUP BY 1),
        sp AS (SELECT series_id, unnest(generate_series(0, n - 1)) AS t FROM ln)
        SELECT sp.series_id, sp.t, coalesce(e1.y, 0) AS y FROM sp LEFT JOIN e1 ON e1.series_id = sp.series_id AND e1.t = sp.t""",
    ),
)
def _(spark, folder):
    shift = F.when(F.col("series_id") % 2 == 0, 5).otherwise(-5)
    wanted = lengths(spark, folder).select("series_id", (F.col("n") + shift).alias("n"))
    return windows.pad_labels(tables.event_panel(spark, folder), wanted, BY)


@query(
    "join_pred_label",
    sql(
        "e1 s1 fl",
        """fg AS (SELECT series_id, w + 40 AS t FROM fl WHERE pred = 1)
        SELECT e1.series_id, e1.t, e1.y, CAST(fg.t IS NOT NULL AS INTEGER) AS pred FROM e1
        LEFT JOIN fg ON fg.series_id = e1.series_id AND fg.t = e1.t""",
    ),
)
def _(spark, folder):
    labels = tables.event_panel(spark, folder).select("series_id", "t", "y")
    flagged = tables.window_flags(spark, folder).where("pred = 1")
    moved = flagged.select("series_id", (F.col("w") + 40).alias("w"), "pred")
    return windows.align_start(moved, labels, BY).select("series_id", "t", "y", "pred")


LABEL_SEGMENTS = """sb AS (SELECT series_id, t, y, CAST(y = 1 AND coalesce(lag(y) OVER (PARTITION BY series_id ORDER BY t), 0) = 0 AS INT) AS s FROM e1),
sn AS (SELECT series_id, t, y, CAST(sum(s) OVER (PARTITION BY series_id ORDER BY t) AS BIGINT) AS seg_id FROM sb),
sg AS (SELECT series_id, seg_id, min(t) AS start_t, max(t) AS end_t FROM sn WHERE y = 1 GROUP BY 1, 2)"""


@query(
    "join_segment_points",
    sql(
        "e1",
        LABEL_SEGMENTS + """, wd AS (SELECT series_id, start_t - 2 AS a, end_t + 3 AS b FROM sg)
        SELECT e1.series_id, e1.t, CAST(bool_or(wd.a IS NOT NULL) AS INTEGER) AS wide FROM e1
        LEFT JOIN wd ON wd.series_id = e1.series_id AND e1.t BETWEEN wd.a AND wd.b GROUP BY 1, 2""",
    ),
)
def _(spark, folder):
    df = tables.event_panel(spark, folder).select("series_id", "t", "y")
    segs = windows.segments(df, BY).withColumns({"start_t": F.col("start_t") - 2, "end_t": F.col("end_t") + 3})
    return windows.paint_segments(df.drop("y"), segs, BY, "wide")


COVER = f"""cv AS (SELECT DISTINCT e1.series_id, e1.t FROM e1 JOIN fl ON fl.series_id = e1.series_id AND fl.pred = 1
  AND e1.t BETWEEN fl.w AND fl.w + {LENGTH - 1})"""


@query("join_window_cover", sql("e1 s1 fl", COVER + " SELECT * FROM cv"))
def _(spark, folder):
    flagged = tables.window_flags(spark, folder).where("pred = 1")
    return windows.window_cover(flagged, lengths(spark, folder), BY, LENGTH)


@query(
    "join_segment_detected",
    sql(
        "e1 s1 fl",
        LABEL_SEGMENTS + ", " + COVER + """ SELECT series_id, seg_id, start_t, end_t, CAST(EXISTS (SELECT 1 FROM cv
        WHERE cv.series_id = sg.series_id AND cv.t BETWEEN start_t AND end_t) AS INTEGER) AS detected FROM sg""",
    ),
)
def _(spark, folder):
    n = lengths(spark, folder)
    cover = windows.window_cover(tables.window_flags(spark, folder).where("pred = 1"), n, BY, LENGTH)
    return evaluate.segments_detected(windows.segments(tables.event_panel(spark, folder), BY), cover, n, BY)


# ---- metrics --------------------------------------------------------------------------

CONFUSION = """cf AS (SELECT series_id, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM tr GROUP BY 1)"""


@query("agg_label_rate", sql("e1", "SELECT series_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_anomalous, round(avg(y) * 100, 6) AS anomaly_pct FROM e1 GROUP BY 1"))
def _(spark, folder):
    return rounded(evaluate.label_rate(tables.event_panel(spark, folder), BY), ["anomaly_pct"])


@query(
    "agg_score_diag",
    sql(
        "e1 s1 fl tr",
        """SELECT series_id, min(score) AS score_min, max(score) AS score_max, round(avg(score), 4) AS score_mean,
        round(stddev_pop(score), 4) AS score_std, round(max(threshold), 9) AS threshold, CAST(sum(pred) AS BIGINT) AS n_flagged,
        round(avg(y) * 100, 6) AS true_rate_pct FROM tr GROUP BY 1""",
    ),
)
def _(spark, folder):
    diag = evaluate.score_diagnostics(tables.window_truth(spark, folder), BY)
    return rounded(rounded(rounded(diag, ["score_mean", "score_std"], 4), ["threshold"], 9), ["true_rate_pct"])


@query("agg_confusion", sql("e1 s1 fl tr", CONFUSION + " SELECT * FROM cf"))
def _(spark, folder):
    return evaluate.confusion(tables.window_truth(spark, folder), BY)


@query(
    "agg_f1",
    sql(
        "e1 s1 fl tr",
        CONFUSION + f""", pr AS (SELECT *, {PRF_OF} FROM cf), ff AS (SELECT *, {F1_OF} FROM pr)
        SELECT series_id, tn, fp, fn, tp, {PRF} FROM ff""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.f1(tables.window_truth(spark, folder), BY), ["precision", "recall", "f1"])


@query(
    "agg_class_report",
    sql(
        "e1 s1 fl tr",
        CONFUSION + f""", ca AS (SELECT sum(tn)::DOUBLE AS tn, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(tp)::DOUBLE AS tp FROM cf),
        cc AS (SELECT '1' AS class, tp, fp, fn, tp + fn AS support FROM ca UNION ALL SELECT '0', tn, fn, fp, tn + fp FROM ca),
        pr AS (SELECT *, {PRF_OF} FROM cc), ff AS (SELECT *, {F1_OF} FROM pr),
        al AS (SELECT class, precision, recall, f1, support FROM ff
        UNION ALL SELECT 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n FROM (SELECT *, tp + tn + fp + fn AS n FROM ca)
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM ff
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM ff)
        SELECT class, {PRF}, CAST(support AS BIGINT) AS support FROM al""",
    ),
)
def _(spark, folder):
    report = evaluate.class_report(tables.window_truth(spark, folder), [])
    return rounded(report, ["precision", "recall", "f1"])


AUC = """ag AS (SELECT {by} score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM {src} GROUP BY ALL),
ar AS (SELECT *, sum(p) OVER ({part} ORDER BY score DESC) AS tp, sum(q) OVER ({part} ORDER BY score DESC) AS fp FROM ag)"""
WHOLE = AUC.format(by="", src="tr", part="")
PER_SERIES = AUC.format(by="series_id,", src="tr", part="PARTITION BY series_id")


def ranks(spark, folder, by):
    bound = tables.series_sizes(spark, folder)
    return evaluate.ranking_metrics(tables.window_scores(spark, folder, ("y",)), by, bound_by=bound)


@query(
    "agg_roc_auc",
    sql(
        "e1 s1 fl tr",
        PER_SERIES + """ SELECT series_id, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg,
        round(CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(q * (tp - p / 2)) / (sum(p) * sum(q)) END, 6) AS roc_auc FROM ar GROUP BY 1""",
    ),
)
def _(spark, folder):
    return rounded(ranks(spark, folder, BY).drop("avg_precision"), ["roc_auc"])


@query(
    "agg_avg_precision",
    sql(
        "e1 s1 fl tr",
        WHOLE + """ SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg,
        round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS avg_precision FROM ar""",
    ),
)
def _(spark, folder):
    return rounded(ranks(spark, folder, []), ["roc_auc", "avg_precision"])


@query(
    "agg_point_adjust",
    sql(
        "e1 s1 fl",
        LABEL_SEGMENTS + ", " + COVER + f""", hs AS (SELECT sn.*, cv.t IS NOT NULL AS hit FROM sn LEFT JOIN cv ON cv.series_id = sn.series_id AND cv.t = sn.t),
        s2 AS (SELECT series_id, seg_id, bool_or(hit) AS hit FROM hs WHERE y = 1 GROUP BY 1, 2),
        s3 AS (SELECT series_id, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn FROM s2 GROUP BY 1),
        s4 AS (SELECT series_id, count(*) FILTER (hit AND y = 0) AS fp FROM hs GROUP BY 1),
        cf AS (SELECT series_id, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, fp FROM s4 LEFT JOIN s3 USING (series_id)),
        pr AS (SELECT *, {PRF_OF} FROM cf), ff AS (SELECT *, {F1_OF} FROM pr)
        SELECT series_id, tp, fn, fp, {PRF}, tp + fn AS n_segments FROM ff""",
    ),
)
def _(spark, folder):
    flagged = tables.window_flags(spark, folder).where("pred = 1")
    out = evaluate.point_adjust(tables.event_panel(spark, folder), flagged, BY, LENGTH)
    return rounded(out, ["precision", "recall", "f1"])


@query(
    "agg_score_separation",
    sql(
        "e1 s1 fl tr",
        "SELECT series_id, round(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0), 4) AS score_sep FROM tr GROUP BY 1",
    ),
)
def _(spark, folder):
    return rounded(evaluate.score_separation(tables.window_scores(spark, folder, ("y",)), BY), ["score_sep"], 4)


TYPES = ["error", "purchase", "signup"]
TYPED = """ty AS (SELECT tr.series_id, tr.score, tr.pred, CAST(e1.event_type IN ('error', 'purchase', 'signup') AS INTEGER) AS y, e1.event_type
  FROM tr JOIN e1 ON e1.series_id = tr.series_id AND e1.t = tr.t_end),
tt AS (SELECT k AS type, ty.* FROM ty JOIN (VALUES ('error'), ('purchase'), ('signup')) v(k) ON y = 0 OR event_type = k)"""


@query(
    "agg_type_metrics",
    sql(
        "e1 s1 fl tr",
        TYPED + f""", cf AS (SELECT type, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn,
        count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 1) AS n_pos,
        round(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0), 4) AS score_sep FROM tt GROUP BY 1),
        pr AS (SELECT *, {PRF_OF} FROM cf), ff AS (SELECT *, {F1_OF} FROM pr),
        """ + AUC.format(by="type,", src="tt", part="PARTITION BY type") + """,
        ap AS (SELECT type, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS avg_precision FROM ar GROUP BY 1)
        SELECT type, round(f1, 6) AS f1, n_pos, avg_precision, score_sep FROM ff JOIN ap USING (type)""",
    ),
)
def _(spark, folder):
    scored = tables.window_flags(spark, folder, ("event_type",))
    positive = F.col("event_type").isin(TYPES)
    scored = scored.withColumns(
        {"y": positive.cast("int"), "type": F.when(positive, F.col("event_type"))}
    ).select("score", "pred", "y", "type")
    out = evaluate.type_metrics(scored, [], TYPES, bound_by=tables.series_sizes(spark, folder))
    return rounded(rounded(out, ["f1", "avg_precision"]), ["score_sep"], 4)


POINTS = list(range(85, 100))
SWEEP = f"""qs AS (SELECT series_id, p AS pct, list_extract(quantile_cont(score, {[p / 100 for p in POINTS]}), p - 84) AS threshold
  FROM tr, range(85, 100) r(p) GROUP BY series_id, p),
cf AS (SELECT series_id, pct, qs.threshold, count(*) FILTER (score > qs.threshold) AS n_detected,
  count(*) FILTER (score > qs.threshold AND y = 1) AS tp, count(*) FILTER (score > qs.threshold AND y = 0) AS fp,
  count(*) FILTER (score <= qs.threshold AND y = 1) AS fn FROM tr JOIN qs USING (series_id) GROUP BY 1, 2, 3),
pr AS (SELECT *, {PRF_OF} FROM cf), ff AS (SELECT *, {F1_OF} FROM pr)"""


def sweep(spark, folder):
    return evaluate.threshold_sweep(
        tables.window_scores(spark, folder, ("y",)), BY, POINTS, bound_by=tables.series_sizes(spark, folder)
    )


@query(
    "agg_threshold_sweep",
    sql("e1 s1 fl tr", SWEEP + f" SELECT series_id, CAST(pct AS INTEGER) AS pct, round(threshold, 9) AS threshold, n_detected, tp, fp, fn, {PRF} FROM ff"),
)
def _(spark, folder):
    return rounded(rounded(sweep(spark, folder), ["threshold"], 9), ["precision", "recall", "f1"])


@query(
    "argmax_sweep",
    sql(
        "e1 s1 fl tr",
        SWEEP + """, bt AS (SELECT series_id, pct, round(f1, 9) AS f1, row_number() OVER (PARTITION BY series_id ORDER BY round(f1, 9) DESC, pct) AS rn FROM ff)
        SELECT series_id, CAST(CASE WHEN f1 > 0 THEN pct ELSE 0 END AS INTEGER) AS best_pct, round(f1, 6) AS best_f1 FROM bt WHERE rn = 1""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.best_threshold(rounded(sweep(spark, folder), ["f1"], 9), BY), ["best_f1"])


@query(
    "sink_report",
    sql(
        "e1 s1 fl tr",
        CONFUSION + f""", pr AS (SELECT *, {PRF_OF} FROM cf), ff AS (SELECT *, {F1_OF} FROM pr)
        SELECT series_id, 'tp' AS metric, CAST(tp AS DOUBLE) AS value FROM ff UNION ALL SELECT series_id, 'fp', fp FROM ff
        UNION ALL SELECT series_id, 'fn', fn FROM ff UNION ALL SELECT series_id, 'tn', tn FROM ff
        UNION ALL SELECT series_id, 'precision', round(precision, 6) FROM ff
        UNION ALL SELECT series_id, 'recall', round(recall, 6) FROM ff UNION ALL SELECT series_id, 'f1', round(f1, 6) FROM ff""",
    ),
)
def _(spark, folder):
    from tidewatch.sources import sinks

    summary = evaluate.f1(tables.window_truth(spark, folder), BY)
    rows = evaluate.report(summary, BY, ["tp", "fp", "fn", "tn", "precision", "recall", "f1"])
    return sinks.through_parquet(rounded(rows, ["value"]), "report")


# ---- node scores ----------------------------------------------------------------------

NODE_ERR = """nm AS (SELECT series_id, node, metric, avg(x) AS m, 2 * ln(CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END) AS lv FROM nl GROUP BY 1, 2, 3),
ne AS (SELECT series_id, t, node, metric, round((m - x) * (m - x) / exp(lv) + lv, 6) AS error
  FROM nl JOIN nm USING (series_id, node, metric)),
ns AS (SELECT series_id, t, node, round(sum(error), 6) AS score FROM ne GROUP BY 1, 2, 3)"""


def node_cells(spark, folder):
    """Gaussian errors against the mean and spread of each supplier, node and metric.

    The panel is made once, and its metrics stay in one row until the errors are known, so that the sum over them
    needs no shuffle of its own rows.
    """
    keys = ["series_id", "node"]
    df = spread.durable(tables.wide_node_panel(spark, folder))
    fitted = spread.lookup_join(df, prepare.fit_moments(df, keys, tables.METRICS), keys)

    def error(m):
        logvar = 2 * F.log(F.when(F.col(f"std_{m}") == 0, 1.0).otherwise(F.col(f"std_{m}")))
        return F.round(losses.gaussian_nll(F.col(m), F.col(f"mean_{m}"), logvar), 6).alias(m)

    errors = fitted.select("series_id", "t", "node", *[error(m) for m in tables.METRICS])
    return panel.to_long(errors, ["series_id", "t", "node"], tables.METRICS, "metric", "error")


def node_scores(spark, folder):
    return rounded(scoring.node_errors(node_cells(spark, folder), ["series_id", "t", "node"]), ["score"])


@query("score_nodes_sum", sql("nl", NODE_ERR + " SELECT series_id, t, round(sum(score), 6) AS score_sum FROM ns GROUP BY 1, 2"))
def _(spark, folder):
    both = scoring.node_sum_max(node_scores(spark, folder), ["series_id", "t"])
    return rounded(both.drop("score_max"), ["score_sum"])


@query("score_nodes_max", sql("nl", NODE_ERR + " SELECT series_id, t, max(score) AS score_max FROM ns GROUP BY 1, 2"))
def _(spark, folder):
    return scoring.node_sum_max(node_scores(spark, folder), ["series_id", "t"]).drop("score_sum")


@query(
    "score_samples_mean",
    "SELECT l_suppkey AS series_id, l_returnflag AS node, avg(l_quantity) AS score FROM lineitem GROUP BY 1, 2",
)
def _(spark, folder):
    samples = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), F.col("l_returnflag").alias("node"), F.col("l_quantity").alias("score")
    )
    return scoring.sample_mean(samples, ["series_id", "node"])


@query(
    "win_rank_nodes",
    sql("nl", NODE_ERR + " SELECT *, CAST(row_number() OVER (PARTITION BY series_id, t ORDER BY score DESC, node) AS INTEGER) AS rank FROM ns"),
)
def _(spark, folder):
    return scoring.rank_nodes(node_scores(spark, folder), ["series_id", "t"])


STEP_ERRORS = f"""w0 AS (SELECT series_id, t, list(round(x * x / 100, 6)) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS sx,
  list(round(k * k / 100, 6)) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS sk FROM e1),
w1 AS (SELECT series_id, t - {LENGTH - 1} AS w, 'x' AS node, sx AS score FROM w0 WHERE t >= {LENGTH - 1}
  UNION ALL SELECT series_id, t - {LENGTH - 1}, 'k', sk FROM w0 WHERE t >= {LENGTH - 1}),
w2 AS (SELECT series_id, node, w, i, score[{LENGTH} - {SHORT} + i + 1] AS s FROM w1, range({SHORT}) r(i)),
lt AS (SELECT series_id, node, w + i AS p, w + i + {LENGTH - SHORT} AS t, round(avg(s), 6) AS score FROM w2 GROUP BY 1, 2, 3, 4)"""


def step_scores(spark, folder):
    """Per-step squared values of two nodes in each window."""
    wins = windows.sliding(tables.event_panel(spark, folder), BY, ["x", "k"], LENGTH)

    def steps(at: int):
        return F.transform("win", lambda r: F.round(r[at] * r[at] / 100, 6))

    cells = F.array(
        *[F.struct(F.lit(n).alias("node"), steps(i).alias("score")) for i, n in enumerate(["x", "k"])]
    )
    return wins.select("series_id", "w", F.inline(cells))


@query("win_lattice", sql("e1", STEP_ERRORS + " SELECT series_id, node, p, t, score FROM lt"))
def _(spark, folder):
    return rounded(windows.lattice(step_scores(spark, folder), ["series_id", "node"], "score", SHORT, LENGTH), ["score"])


@query(
    "interpret_nodes",
    sql(
        "e1",
        STEP_ERRORS + """, lq AS (SELECT series_id, quantile_cont(score, 0.95) AS threshold FROM lt GROUP BY 1)
        SELECT series_id, node, p, t, score, round(threshold, 9) AS threshold, CAST(score > threshold AS INTEGER) AS pred,
        CAST(row_number() OVER (PARTITION BY series_id, p ORDER BY score DESC, node) AS INTEGER) AS rank FROM lt JOIN lq USING (series_id)""",
    ),
)
def _(spark, folder):
    return rounded(scoring.interpret_nodes(step_scores(spark, folder), BY, SHORT, LENGTH), ["threshold"], 9)
