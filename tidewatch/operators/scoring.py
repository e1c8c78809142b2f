"""Window errors, group combination, tail calibration, thresholds and node scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import losses
from tidewatch.operators import spread, windows


def window_mean_error(
    df: DataFrame,
    by: Sequence[str],
    features: Sequence[str],
    length: int,
    t: str = "t",
    size: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Mean squared error of reconstructing each window by its own mean: (by, w, t_end, score).

    The error of a feature is the population variance of the frame, so no window array is built.
    ``carry`` names columns of the window's last row to keep, such as its label.
    """

    def build(w):
        frame = w.rowsBetween(-(length - 1), 0)
        errors = [F.var_pop(f).over(frame) for f in features]
        total = errors[0]
        for e in errors[1:]:
            total = total + e
        return {"score": total / F.lit(float(len(features))), "_len": F.count(F.lit(1)).over(frame)}

    kept = list(dict.fromkeys([*features, *carry]))
    out = spread.windowed(df.select(*by, t, *kept), by, length - 1, 0, build=build, t=t, size=size)
    return out.where(F.col("_len") == length).select(
        *by, (F.col(t) - (length - 1)).alias("w"), F.col(t).alias("t_end"), "score", *carry
    )


def window_mean_group_errors(
    df: DataFrame,
    by: Sequence[str],
    groups: Mapping[int, Sequence[str]],
    length: int,
    t: str = "t",
    size: int | None = None,
) -> DataFrame:
    """The same per feature group: (by, w, grp, loss)."""
    features = sorted({f for cols in groups.values() for f in cols})

    def build(w):
        frame = w.rowsBetween(-(length - 1), 0)
        return {**{f"_v_{f}": F.var_pop(f).over(frame) for f in features}, "_len": F.count(F.lit(1)).over(frame)}

    out = spread.windowed(df.select(*by, t, *features), by, length - 1, 0, build=build, t=t, size=size)
    cells = []
    for g, cols in sorted(groups.items()):
        total = F.col(f"_v_{cols[0]}")
        for c in cols[1:]:
            total = total + F.col(f"_v_{c}")
        cells.append(F.struct(F.lit(g).alias("grp"), (total / F.lit(float(len(cols)))).alias("loss")))
    return out.where(F.col("_len") == length).select(
        *by, (F.col(t) - (length - 1)).alias("w"), F.inline(F.array(*cells))
    )


def group_losses(
    pairs: DataFrame, keys: Sequence[str], groups: Mapping[int, bool], x: str = "x", xhat: str = "xhat"
) -> DataFrame:
    """(keys, grp, loss) from columns x_<g>, xhat_<g>: cross-entropy for binary groups, else MSE."""
    cells = []
    for g, binary in sorted(groups.items()):
        loss = losses.bce_with_logits if binary else losses.mse
        cells.append(F.struct(F.lit(g).alias("grp"), loss(F.col(f"{x}_{g}"), F.col(f"{xhat}_{g}")).alias("loss")))
    return pairs.select(*keys, F.inline(F.array(*cells)))


def weighted_score(
    per_group: DataFrame,
    keys: Sequence[str],
    weights: Mapping[int, float],
    kl: str | None = None,
    kl_weight: float = 0.0,
) -> DataFrame:
    """Weighted sum of group losses with weights normalised to 1, plus kl_weight times the KL column."""
    total = float(sum(weights.values()))
    weight = F.lit(0.0)
    for g, v in weights.items():
        weight = F.when(F.col("grp") == g, F.lit(v / total)).otherwise(weight)
    score = F.sum(weight * F.col("loss"))
    if kl is not None and kl_weight > 0:
        score = score + F.lit(kl_weight) * F.max(kl)
    return per_group.groupBy(*keys).agg(score.alias("score"))


def trim(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: tuple[float, float] = (0.005, 0.995),
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """Rows whose value lies within the two quantiles of its group, both included."""
    q = spread.percentiles(df, by, value, quantiles, limit, bound_by)
    near = spread.lookup_join(df, q, by)
    return near.where((F.col(value) >= F.col("q")[0]) & (F.col(value) <= F.col("q")[1])).select(*df.columns)


def fit_ecdf(
    baseline: DataFrame,
    by: Sequence[str],
    value: str = "loss",
    quantiles: tuple[float, float] | None = (0.005, 0.995),
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """Empirical distribution of trimmed baseline losses: (by, loss, n) per distinct loss."""
    kept = baseline if quantiles is None else trim(baseline, by, value, quantiles, limit, bound_by)
    return kept.groupBy(*by, value).agg(F.count("*").alias("n"))


def cumulative(ecdf: DataFrame, by: Sequence[str], value: str = "loss", limit: int | None = None) -> DataFrame:
    """Add cum: baseline values at or below."""
    return spread.running_totals(ecdf, by, [F.col(value)], {"cum": F.col("n")}, limit)


def count_below(
    df: DataFrame,
    ecdf: DataFrame,
    by: Sequence[str],
    row_key: Sequence[str],
    value: str = "loss",
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """Rows of df with ``below`` (baseline values <= value) and ``n_base``.

    Baseline and rows are merged in value order, baseline first on ties, and counted along.
    """
    by, row_key = list(by), list(row_key)
    rows = df.select(*by, value, *row_key, F.lit(0).cast("bigint").alias("_n"), F.lit(1).alias("_row"))
    base = ecdf.select(
        *by,
        value,
        *[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in row_key],
        F.col("n").alias("_n"),
        F.lit(0).alias("_row"),
    )
    order = [F.col(value), F.col("_row"), *[F.col(k) for k in row_key]]
    run = spread.running_totals(base.unionByName(rows), by, order, {"below": F.col("_n")}, limit, bound_by)
    sizes = ecdf.groupBy(*by).agg(F.sum("n").alias("n_base"))
    out = spread.lookup_join(run.where(F.col("_row") == 1).drop("_n", "_row"), sizes, by, "left")
    return out.withColumn("n_base", F.coalesce("n_base", F.lit(0)))


def ecdf_scores(
    df: DataFrame,
    ecdf: DataFrame,
    by: Sequence[str],
    row_key: Sequence[str],
    group: str = "grp",
    combine: str = "mean",
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """Tail score of every (row, group) loss, combined over groups: (by, row_key, score)."""
    below = count_below(df, ecdf, [*by, group], row_key, "loss", limit, bound_by)
    tail = losses.tail_score(F.col("below"), F.col("n_base"))
    how = F.max if combine == "max" else F.avg
    return below.groupBy(*by, *row_key).agg(how(tail).alias("score"))


def fit_threshold(
    baseline: DataFrame,
    by: Sequence[str],
    percentile: float,
    score: str = "score",
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """(by, threshold): percentile of the baseline scores."""
    q = spread.percentiles(baseline, by, score, [percentile / 100], limit, bound_by)
    return q.select(*by, F.col("q")[0].alias("threshold"))


def flag(scored: DataFrame, thresholds: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Add threshold and pred = score strictly above it; both are null for a series without a threshold."""
    out = spread.lookup_join(scored, thresholds, by, "left")
    return out.withColumn("pred", (F.col(score) > F.col("threshold")).cast("int"))


def unfitted(flagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Series without a threshold and their rows: (by, n)."""
    return flagged.where(F.col("threshold").isNull()).groupBy(*by).agg(F.count("*").alias("n"))


# ---- node scores ----------------------------------------------------------------------


def node_errors(cells: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """Per node: sum over metrics. ``keys`` ends with the node column."""
    return cells.groupBy(*keys).agg(F.sum(error).alias("score"))


def node_sum_max(node_scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over the nodes of one step: sum and maximum."""
    return node_scores.groupBy(*keys).agg(F.sum("score").alias("score_sum"), F.max("score").alias("score_max"))


def sample_mean(samples: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Mean of repeated scores of the same cell."""
    return samples.groupBy(*keys).agg(F.avg(score).alias("score"))


def rank_nodes(node_scores: DataFrame, keys: Sequence[str], node: str = "node") -> DataFrame:
    """Nodes of each step by descending score, names breaking ties; rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col(node))
    return node_scores.withColumn("rank", F.row_number().over(order))


def interpret_nodes(
    step_scores: DataFrame,
    by: Sequence[str],
    delay: int,
    length: int,
    percentile: float = 95.0,
    limit: int | None = None,
) -> DataFrame:
    """Ranked, lattice-averaged node scores with flags.

    ``step_scores``: (by, w, node, score array over the window's steps). One threshold per
    series over all node and time cells. The nodes of one step are few and ranked together.
    """
    cells = windows.lattice(step_scores, [*by, "node"], "score", delay, length)
    cells = spread.durable(cells.withColumn("score", F.round("score", 6)))
    cut = fit_threshold(cells, by, percentile, limit=limit)
    return rank_nodes(flag(cells, cut, by), [*by, "p"])
