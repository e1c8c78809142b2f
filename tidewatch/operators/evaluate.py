"""Detection metrics as grouped aggregates. ``by`` may be empty (one overall row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import losses
from tidewatch.operators import panel, spread, windows


def confusion(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """tn, fp, fn, tp per group."""

    def cell(a, b):
        return F.count_if((F.col(y) == a) & (F.col(pred) == b))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1 to confusion counts; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": losses.ratio(tp, tp + fp), "recall": losses.ratio(tp, tp + fn)})
    return out.withColumn("f1", losses.f_score(F.col("precision"), F.col("recall")))


def f1(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return precision_recall_f1(confusion(df, by, y, pred))


def class_report(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Rows 0, 1, accuracy, macro avg and weighted avg: precision, recall, f1, support."""
    c = confusion(df, by, y, pred)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def scores(hit, wrong, missed):
        p, r = losses.ratio(hit, hit + wrong), losses.ratio(hit, hit + missed)
        return p, r, losses.f_score(p, r)

    neg, pos = scores(tn, fn, fp), scores(tp, fp, fn)
    accuracy = losses.ratio(tp + tn, n)
    rows = [("0", *neg, tn + fp), ("1", *pos, tp + fn), ("accuracy", accuracy, accuracy, accuracy, n)]
    macro = [(a + b) / 2 for a, b in zip(neg, pos)]
    weighted = [losses.ratio(a * (tn + fp) + b * (tp + fn), n) for a, b in zip(neg, pos)]
    rows += [("macro avg", *macro, n), ("weighted avg", *weighted, n)]
    names = ("class", "precision", "recall", "f1", "support")
    cells = [
        F.struct(F.lit(r[0]).alias("class"), *[v.alias(k) for k, v in zip(names[1:], r[1:])]) for r in rows
    ]
    return c.select(*by, F.inline(F.array(*cells)))


def ranking_metrics(
    df: DataFrame,
    by: Sequence[str],
    score: str = "score",
    y: str = "y",
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """(by, n_pos, n_neg, roc_auc, avg_precision) from one descending pass over distinct scores.

    Ties share a threshold. Both metrics are null when only one class is present.
    """
    by = list(by)
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg")
    )
    run = spread.running_totals(
        counts, by, [F.desc(score)], {"_tp": F.col("_pos"), "_fp": F.col("_neg")}, limit, bound_by
    )
    sums = run.groupBy(*by).agg(
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
        F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2)).alias("_area"),
        F.sum(F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("_ap"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(
        *by,
        "n_pos",
        "n_neg",
        F.when(both, F.col("_area") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("n_pos")).alias("avg_precision"),
    )


def score_separation(df: DataFrame, by: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Mean score of positives minus mean score of negatives; null without positives."""
    gap = F.avg(F.when(F.col(y) == 1, F.col(score))) - F.avg(F.when(F.col(y) == 0, F.col(score)))
    return df.groupBy(*by).agg(gap.alias("score_sep"))


def label_rate(df: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(y).alias("n_anomalous"), (F.avg(y) * 100).alias("anomaly_pct")
    )


def score_diagnostics(flags: DataFrame, by: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Range, mean and spread of scores, the threshold, flags and true rate."""
    return flags.groupBy(*by).agg(
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_std"),
        F.max("threshold").alias("threshold"),
        F.sum("pred").alias("n_flagged"),
        (F.avg(y) * 100).alias("true_rate_pct"),
    )


def point_adjust(
    labels: DataFrame, flagged: DataFrame, by: Sequence[str], length: int, y: str = "y", size: int | None = None
) -> DataFrame:
    """Segment-level recall against point-level false alarms.

    tp and fn count labelled segments (hit when any of their positions is covered by a
    flagged window); fp counts covered positions outside segments.
    """
    by = list(by)
    numbered = windows.covered_segments(labels, flagged, by, length, y, size)
    segment = F.when(F.col(y) == 1, F.col("seg_id"))
    per_segment = numbered.groupBy(*by, segment.alias("_seg")).agg(
        F.max("hit").alias("_hit"), F.sum("hit").alias("_points")
    )
    inside = F.col("_seg").isNotNull()
    counts = per_segment.groupBy(*by).agg(
        F.count_if(inside & (F.col("_hit") == 1)).alias("tp"),
        F.count_if(inside & (F.col("_hit") == 0)).alias("fn"),
        F.coalesce(F.sum(F.when(~inside, F.col("_points"))), F.lit(0)).alias("fp"),
    )
    return precision_recall_f1(counts).withColumn("n_segments", F.col("tp") + F.col("fn"))


def segments_detected(segs: DataFrame, cover: DataFrame, lengths: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, seg_id, detected): whether any position of the segment, clipped to its series, is covered.

    The covered positions before the segment's start and up to its end are counted by one running sum: a segment is two
    rows, however long it is.
    """
    by = list(by)
    inside = spread.lookup_join(segs.select(*by, "seg_id", "start_t", "end_t"), lengths, by)
    first, last = F.greatest(F.col("start_t"), F.lit(0)), F.least(F.col("end_t"), F.col("n") - 1)
    inside = inside.where(first <= last)
    ends = inside.select(
        *by, "seg_id", F.inline(F.array(
            F.struct((2 * first).cast("bigint").alias("_pos"), F.lit(-1).alias("_side")),
            F.struct((2 * last + 2).cast("bigint").alias("_pos"), F.lit(1).alias("_side")),
        ))
    )
    points = cover.select(*by, (2 * F.col("t") + 1).cast("bigint").alias("_pos"), F.lit(1).alias("_c"))
    both = points.unionByName(ends.withColumn("_c", F.lit(0)), allowMissingColumns=True)
    counted = spread.bucket_running(both, by, {"_upto": F.col("_c")}, t="_pos").where("_side IS NOT NULL")
    hits = counted.groupBy(*by, "seg_id").agg(F.sum(F.col("_side") * F.col("_upto")).alias("_hits")).where("_hits > 0")
    out = segs.join(hits, [*by, "seg_id"], "left")
    return out.select(*by, "seg_id", "start_t", "end_t", F.coalesce(F.sign("_hits").cast("int"), F.lit(0)).alias("detected"))


def threshold_sweep(
    scored: DataFrame,
    by: Sequence[str],
    points: Sequence[float],
    baseline: DataFrame | None = None,
    score: str = "score",
    y: str = "y",
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """Per percentile point: threshold (of ``baseline`` or the scores themselves), flags, F1."""
    by = list(by)
    q = spread.percentiles(
        scored if baseline is None else baseline, by, score, [p / 100 for p in points], limit, bound_by
    )
    cuts = spread.lookup_join(scored.select(*by, score, y), q, by)
    above = [(F.col(score) > F.col("q")[i]) for i in range(len(points))]
    wide = cuts.groupBy(*by).agg(
        F.first("q").alias("q"),
        F.sum(F.col(y)).alias("_pos"),
        *[F.count_if(a).alias(f"_n{i}") for i, a in enumerate(above)],
        *[F.count_if(a & (F.col(y) == 1)).alias(f"_tp{i}") for i, a in enumerate(above)],
    )
    cells = [
        F.struct(
            F.lit(int(p)).alias("pct"),
            F.col("q")[i].alias("threshold"),
            F.col(f"_n{i}").alias("n_detected"),
            F.col(f"_tp{i}").alias("tp"),
        )
        for i, p in enumerate(points)
    ]
    rows = wide.select(*by, "_pos", F.inline(F.array(*cells)))
    counts = rows.select(
        *by,
        "pct",
        "threshold",
        "n_detected",
        "tp",
        (F.col("n_detected") - F.col("tp")).alias("fp"),
        (F.col("_pos") - F.col("tp")).alias("fn"),
    )
    return precision_recall_f1(counts)


def best_threshold(sweep: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first percentile with the strictly greatest F1; 0 and 0 when none is above 0."""
    best = F.max_by(F.struct("pct", "f1"), F.struct(F.col("f1"), -F.col("pct")))
    out = sweep.groupBy(*by).agg(best.alias("_b"))
    some = F.col("_b.f1") > 0
    return out.select(
        *by,
        F.when(some, F.col("_b.pct")).otherwise(0).alias("best_pct"),
        F.when(some, F.col("_b.f1")).otherwise(0.0).alias("best_f1"),
    )


def type_metrics(
    scored: DataFrame,
    by: Sequence[str],
    types: Sequence[str],
    kind: str = "type",
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """(by, type, f1, n_pos, avg_precision, score_sep) of each anomaly type against the normal rows.

    ``scored`` has score, pred, y and ``kind`` (null on normal rows). A positive row counts for
    its own type only; the normal rows count for every type and are read once, not once per type.
    """
    by, types = list(by), list(types)
    normal = F.col("y") == 0
    of = [(F.col("y") == 1) & (F.col(kind) == k) for k in types]
    flagged = F.col("pred") == 1
    flat = scored.groupBy(*by).agg(
        F.count_if(normal & flagged).alias("_fp"),
        F.avg(F.when(normal, F.col("score"))).alias("_mean"),
        *[F.count_if(m).alias(f"_n{i}") for i, m in enumerate(of)],
        *[F.count_if(m & flagged).alias(f"_tp{i}") for i, m in enumerate(of)],
        *[F.avg(F.when(m, F.col("score"))).alias(f"_mean{i}") for i, m in enumerate(of)],
    )
    cells = [
        F.struct(
            F.lit(k).alias("type"),
            F.col(f"_tp{i}").alias("tp"),
            F.col("_fp").alias("fp"),
            (F.col(f"_n{i}") - F.col(f"_tp{i}")).alias("fn"),
            F.col(f"_n{i}").alias("n_pos"),
            (F.col(f"_mean{i}") - F.col("_mean")).alias("score_sep"),
        )
        for i, k in enumerate(types)
    ]
    rates = precision_recall_f1(flat.select(*by, F.inline(F.array(*cells))))

    counts = scored.where(F.col("score").isNotNull()).groupBy(*by, "score").agg(
        F.count_if(normal).alias("_neg"), *[F.count_if(m).alias(f"_pos{i}") for i, m in enumerate(of)]
    )
    totals = {"_fp": F.col("_neg"), **{f"_tp{i}": F.col(f"_pos{i}") for i in range(len(types))}}
    run = spread.running_totals(counts, by, [F.desc("score")], totals, limit, bound_by)

    def gain(i: int) -> Column:
        pos, tp = F.col(f"_pos{i}"), F.col(f"_tp{i}")
        return F.sum(F.when(pos > 0, pos * tp / (tp + F.col("_fp"))).otherwise(0.0))

    sums = run.groupBy(*by).agg(
        F.sum("_neg").alias("_n_neg"),
        *[F.sum(f"_pos{i}").alias(f"_n{i}") for i in range(len(types))],
        *[gain(i).alias(f"_ap{i}") for i in range(len(types))],
    )
    both = [(F.col("_n_neg") > 0) & (F.col(f"_n{i}") > 0) for i in range(len(types))]
    cells = [
        F.struct(
            F.lit(k).alias("type"),
            F.when(both[i], F.col(f"_ap{i}") / F.col(f"_n{i}")).alias("avg_precision"),
        )
        for i, k in enumerate(types)
    ]
    ranked = sums.select(*by, F.inline(F.array(*cells)))
    return rates.join(ranked, [*by, "type"]).select(*by, "type", "f1", "n_pos", "avg_precision", "score_sep")


def global_mse(df: DataFrame, by: Sequence[str], x: Column, xhat: Column) -> DataFrame:
    """Sum of squared errors over sum of elements, for array columns."""
    out = df.groupBy(*by).agg(
        F.sum(losses.total(losses.squared_errors(x, xhat))).alias("sse"), F.sum(F.size(x)).alias("n_elements")
    )
    return out.withColumn("mse", F.col("sse") / F.col("n_elements"))


def report(summary: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric, for a report table."""
    wide = summary.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics])
    return panel.to_long(wide, by, metrics, "metric", "value")
