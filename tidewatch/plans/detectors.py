"""Whole detectors: fit on a panel, transform a panel into flagged windows, compare variants."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import evaluate, prepare, reconstruct, scoring, spread, windows


@dataclass(frozen=True)
class Detector:
    """Unfitted detector: ``fit(panel)`` gives a :class:`FittedDetector`."""

    by: Sequence[str]
    features: Sequence[str]
    length: int
    percentile: float = 95.0
    digits: int | None = None

    def reconstruction(self, panel: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """Learn from a panel; the result maps a panel to (by, w, t_end, score)."""
        raise NotImplementedError

    def fit(self, panel: DataFrame) -> "FittedDetector":
        score = self.reconstruction(panel)

        def rounded(df: DataFrame) -> DataFrame:
            scored = score(df)
            return scored if self.digits is None else scored.withColumn("score", F.round("score", self.digits))

        cuts = scoring.fit_threshold(rounded(panel), self.by, self.percentile, bound_by=panel)
        return FittedDetector(self, rounded, spread.durable(cuts))


@dataclass(frozen=True)
class FittedDetector:
    detector: Detector
    score: Callable[[DataFrame], DataFrame]
    thresholds: DataFrame

    def transform(self, panel: DataFrame) -> DataFrame:
        """(by, w, t_end, score, threshold, pred)."""
        return scoring.flag(self.score(panel), self.thresholds, self.detector.by)


@dataclass(frozen=True)
class WindowDetector(Detector):
    """Reconstructs each window by its mean."""

    def reconstruction(self, panel):
        return lambda df: scoring.window_mean_error(df, self.by, self.features, self.length)


@dataclass(frozen=True)
class PcaDetector(Detector):
    """Reconstructs standardised windows by their leading directions."""

    k: int = field(default=4)

    def reconstruction(self, panel):
        stats = spread.durable(prepare.fit_moments(panel, self.by, self.features))

        def wins(df):
            scaled = prepare.scale_standard(df, stats, self.by, self.features)
            return windows.flatten_windows(windows.sliding(scaled, self.by, self.features, self.length))

        scaled = spread.durable(prepare.scale_standard(panel, stats, self.by, self.features))
        model = reconstruct.WindowPca.fit_panel(scaled, self.by, self.features, self.length, self.k)
        return lambda df: reconstruct.pca_errors(wins(df), model, [*self.by, "w", "t_end"])


@dataclass(frozen=True)
class CalibratedDetector:
    """Tail scores of group losses against training losses, and a cut from held-out scores.

    ``fit`` splits the panel's windows along time: the first part gives each group's trimmed
    distribution of losses, the last ``holdout`` of them is scored on that scale and gives the cut.
    ``combine`` (mean or max) joins the groups. ``losses`` maps a panel to (by, w, grp, loss); by
    default windows are reconstructed by their mean.
    """

    by: Sequence[str]
    groups: Mapping[int, Sequence[str]]
    length: int
    percentile: float = 95.0
    combine: str = "mean"
    quantiles: tuple[float, float] | None = (0.005, 0.995)
    holdout: float = 0.3
    digits: int | None = None
    losses: Callable[[DataFrame], DataFrame] | None = None

    def group_losses(self, panel: DataFrame) -> DataFrame:
        if self.losses is not None:
            out = self.losses(panel)
        else:
            out = scoring.window_mean_group_errors(panel, self.by, self.groups, self.length)
        return out if self.digits is None else out.withColumn("loss", F.round("loss", self.digits))

    def fit(self, panel: DataFrame) -> "FittedCalibrated":
        keys = [*self.by, "grp"]
        split = spread.durable(prepare.split_contiguous(self.group_losses(panel), self.by, self.holdout, t="w"))
        ecdf = spread.durable(scoring.fit_ecdf(split.where("split = 'train'"), keys, quantiles=self.quantiles))
        held = spread.durable(self.scores(split.where("split = 'val'"), ecdf))
        cuts = spread.durable(scoring.fit_threshold(held, self.by, self.percentile))
        return FittedCalibrated(self, ecdf, held, cuts)

    def scores(self, losses: DataFrame, ecdf: DataFrame) -> DataFrame:
        out = scoring.ecdf_scores(losses, ecdf, self.by, ["w"], combine=self.combine)
        return out if self.digits is None else out.withColumn("score", F.round("score", self.digits))


@dataclass(frozen=True)
class FittedCalibrated:
    """What a calibrated detector has learned, as tables: losses' distribution, held-out scores, cuts."""

    detector: CalibratedDetector
    ecdf: DataFrame
    held_out: DataFrame
    thresholds: DataFrame

    def score(self, panel: DataFrame) -> DataFrame:
        return self.detector.scores(self.detector.group_losses(panel), self.ecdf)

    def transform(self, panel: DataFrame, fallback: bool = False) -> DataFrame:
        """(by, w, t_end, score, threshold, pred); with ``fallback`` a series without a cut takes
        the percentile of the scores at hand."""
        by = list(self.detector.by)
        scored, cuts = self.score(panel), self.thresholds
        if fallback:
            scored = spread.durable(scored)
            own = scoring.fit_threshold(scored, by, self.detector.percentile)
            own = own.withColumnRenamed("threshold", "_own")
            both = spread.join_null_safe(own, cuts, by, "left")
            cuts = both.select(*by, F.coalesce("threshold", "_own").alias("threshold"))
        flags = scoring.flag(scored, cuts, by)
        return flags.select(*by, "w", (F.col("w") + self.detector.length - 1).alias("t_end"), "score", "threshold", "pred")

    def report(self, panel: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """Counts, precision, recall and F1 of the flags of a panel, per ``keys`` (some of ``by``)."""
        by = self.detector.by
        return evaluate.f1(windows.align_end(self.transform(panel), labels, by, self.detector.length), list(keys))

    def sweep(self, panel: DataFrame, labels: DataFrame, points: Sequence[float]) -> DataFrame:
        """F1 of the panel's scores at cuts from percentiles of the held-out scores."""
        by = self.detector.by
        scored = windows.align_end(self.transform(panel), labels, by, self.detector.length)
        return evaluate.threshold_sweep(scored, by, points, baseline=self.held_out)


def corrupted_mse(
    df: DataFrame, by: Sequence[str], x: str, corrupt: Callable[[Column], Column]
) -> DataFrame:
    """Global error of a corrupted array column against the clean one."""
    return evaluate.global_mse(df, by, F.col(x), corrupt(F.col(x)))


def run_grid(
    panel: DataFrame,
    labels: DataFrame,
    by: Sequence[str],
    variants: Mapping[str, Callable[[int], Detector]],
    seeds: Sequence[int],
    length: int,
) -> DataFrame:
    """(seed, variant, f1, aucpr, auroc, score_sep): every variant and seed, measured in one grouped job."""
    scored = None
    for seed in seeds:
        for name, make in variants.items():
            flags = make(seed).fit(panel).transform(panel)
            part = windows.align_end(flags, labels, by, length).select(
                F.lit(seed).alias("seed"), F.lit(name).alias("variant"), "score", "pred", "y"
            )
            scored = part if scored is None else scored.unionByName(part)
    keys = ["seed", "variant"]
    ranks = evaluate.ranking_metrics(scored, keys)
    return (
        evaluate.f1(scored, keys)
        .select(*keys, "f1")
        .join(ranks.select(*keys, F.col("avg_precision").alias("aucpr"), F.col("roc_auc").alias("auroc")), keys)
        .join(evaluate.score_separation(scored, keys), keys)
    )


def grid_trials(
    spark: SparkSession,
    study: str,
    objective: Callable[[dict], DataFrame],
    grid: Sequence[dict[str, float]],
    value: str = "f1",
) -> DataFrame:
    """Trial rows (study, trial, state, value, params) of a one-row objective over a parameter grid."""
    out = None
    for i, params in enumerate(grid):
        held = F.create_map(*[F.lit(v) for kv in params.items() for v in kv])
        row = objective(params).select(
            F.lit(study).alias("study"),
            F.lit(i).cast("bigint").alias("trial"),
            F.lit("COMPLETE").alias("state"),
            F.col(value).alias("value"),
            held.alias("params"),
        )
        out = row if out is None else out.unionByName(row)
    return out
