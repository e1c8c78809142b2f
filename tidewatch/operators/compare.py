"""Comparing runs (seed, variant, type, metrics) and trials (study, trial, state, value, params)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import losses
from tidewatch.operators import panel, spread


def variant_summary(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """mean_<m> and std_<m> (population) per variant, NaN skipped."""
    clean = runs.withColumns({m: panel.clean_number(F.col(m)) for m in metrics})
    return clean.groupBy(*by).agg(
        *[F.avg(m).alias(f"mean_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"std_{m}") for m in metrics]
    )


def against_baseline(runs: DataFrame, on: Sequence[str], metric: str, baseline: str = "none") -> DataFrame:
    """Each candidate row beside the baseline row with the same seed (and type): metric, base."""
    base = runs.where(F.col("variant") == baseline).select(*on, F.col(metric).alias("base"))
    return runs.where(F.col("variant") != baseline).select(*on, "variant", metric).join(base, list(on))


def win_counts(runs: DataFrame, on: Sequence[str], by: Sequence[str], metric: str, baseline: str = "none") -> DataFrame:
    """(by, wins, n): pairs in which the candidate is strictly better."""
    pairs = against_baseline(runs, on, metric, baseline)
    better = F.coalesce((F.col(metric) > F.col("base")) & ~F.isnan(metric) & ~F.isnan("base"), F.lit(False))
    return pairs.groupBy(*by).agg(F.count_if(better).alias("wins"), F.count("*").alias("n"))


def acceptance(
    runs: DataFrame, metric: str, hard: Sequence[str], control: Sequence[str], baseline: str = "none"
) -> DataFrame:
    """Per candidate: seeds won on the mean of hard types, mean and std of the control-type change."""
    x = panel.clean_number(F.col(metric))
    per_seed = runs.groupBy("seed", "variant").agg(
        F.avg(F.when(F.col("type").isin(list(hard)), x)).alias("hard"),
        F.avg(F.when(F.col("type").isin(list(control)), x)).alias("control"),
    )
    base = per_seed.where(F.col("variant") == baseline).select(
        "seed", F.col("hard").alias("_hard"), F.col("control").alias("_control")
    )
    pairs = per_seed.where(F.col("variant") != baseline).join(base, "seed")
    delta = F.col("control") - F.col("_control")
    return pairs.groupBy("variant").agg(
        F.count_if(F.col("hard") > F.col("_hard")).alias("hard_wins"),
        F.count("*").alias("n_seeds"),
        F.avg(delta).alias("control_delta_mean"),
        F.stddev_pop(delta).alias("control_delta_std"),
    )


def trial_stats(trials: DataFrame, limit: int | None = None) -> DataFrame:
    """Per study: trials by state; best, mean, std and median of the completed values."""
    done = F.col("state") == "COMPLETE"
    value = F.when(done, F.col("value"))
    stats = trials.groupBy("study").agg(
        F.count("*").alias("n_trials"),
        F.count_if(done).alias("n_completed"),
        F.count_if(F.col("state") == "PRUNED").alias("n_pruned"),
        F.max(value).alias("best"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )
    medians = spread.percentiles(trials.where(done), ["study"], "value", [0.5], limit)
    return stats.join(medians.select("study", F.col("q")[0].alias("median")), "study", "left")


def param_correlation(trials: DataFrame, param: str = "kl_weight", default: float = 0.1) -> DataFrame:
    """Per study: correlation of a parameter with the value over completed trials."""
    x = F.coalesce(F.try_element_at("params", F.lit(param)), F.lit(default))
    done = trials.where(F.col("state") == "COMPLETE")
    return done.groupBy("study").agg(losses.correlation(x, F.col("value")).alias("corr"))


def best_trial(trials: DataFrame, direction: str = "maximize") -> DataFrame:
    """(study, trial, value, params) of the best completed trial, the earlier one on ties."""
    done = trials.where(F.col("state") == "COMPLETE")
    row = F.struct("trial", "value", "params")
    if direction == "maximize":
        best = F.max_by(row, F.struct(F.col("value"), -F.col("trial")))
    else:
        best = F.min_by(row, F.struct("value", "trial"))
    return done.groupBy("study").agg(best.alias("_b")).select("study", "_b.*")


def running_best(trials: DataFrame, size: int | None = None) -> DataFrame:
    """Completed trials with the best value so far, never under 0."""
    done = trials.where(F.col("state") == "COMPLETE").select("study", "trial", "value")
    out = spread.bucket_running(done, ["study"], maxima={"best": F.col("value")}, t="trial", size=size)
    return out.withColumn("best", F.greatest(F.col("best"), F.lit(0.0)))
