"""Cleaning, imputation, per-series statistics, scaling and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import draws
from tidewatch.operators import panel, spread


# ---- cleaning -------------------------------------------------------------------------


def clean_label(c: Column) -> Column:
    """Plant labels: outer blanks and the split spelling of the attack label."""
    return F.regexp_replace(F.trim(c), "^A ttack$", "Attack")


def attack_flag(c: Column) -> Column:
    return (clean_label(c) == "Attack").cast("int")


def coerce_numeric(c: Column) -> Column:
    return panel.clean_number(c.try_cast("double"))


def missing_counts(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    missing = [F.count_if(F.col(f).isNull() | F.isnan(f)).alias(f) for f in features]
    wide = df.groupBy(*by).agg(*missing)
    return panel.to_long(wide, by, features, "feature", "n_missing")


def assert_no_nan(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df itself, after checking that no feature holds a null or NaN."""
    bad = F.lit(False)
    for f in features:
        bad = bad | F.col(f).isNull() | F.isnan(f)
    if df.where(bad).take(1):
        raise ValueError("the panel holds missing or non-numeric values")
    return df


# ---- imputation -----------------------------------------------------------------------


def interpolate(
    df: DataFrame, by: Sequence[str], features: Sequence[str], t: str = "t", size: int | None = None
) -> DataFrame:
    """Fill gaps linearly in t; the tail takes the last value and the head the first one.

    Buckets of t are filled side by side: the nearest known point outside a bucket comes
    from a table with one row per bucket.
    """
    by = list(by)
    known = {
        f: F.when(F.col(f).isNotNull() & ~F.isnan(f), F.struct(F.col(t).alias("t"), F.col(f).cast("double").alias("x")))
        for f in features
    }
    df = df.withColumn("_bucket", spread.bucket_of(t, size)).repartition(*by, "_bucket")
    edges = df.groupBy(*by, "_bucket").agg(
        *[F.max(p).alias(f"_last_{f}") for f, p in known.items()],
        *[F.min(p).alias(f"_first_{f}") for f, p in known.items()],
    )
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *by,
        "_bucket",
        *[F.last(f"_last_{f}", ignorenulls=True).over(earlier).alias(f"_before_{f}") for f in features],
        *[F.last(f"_first_{f}", ignorenulls=True).over(later).alias(f"_after_{f}") for f in features],
    )
    up = Window.partitionBy(*by, "_bucket").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "_bucket").orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(carried, [*by, "_bucket"])
    ends = joined.select(
        *df.columns,
        *[
            F.coalesce(F.last(p, ignorenulls=True).over(up), F.col(f"_before_{f}")).alias(f"_l_{f}")
            for f, p in known.items()
        ],
        *[
            F.coalesce(F.last(p, ignorenulls=True).over(down), F.col(f"_after_{f}")).alias(f"_r_{f}")
            for f, p in known.items()
        ],
    )

    def filled(f: str) -> Column:
        left, right = F.col(f"_l_{f}"), F.col(f"_r_{f}")
        slope = (right["x"] - left["x"]) / (right["t"] - left["t"])
        return (
            F.when(left.isNull(), right["x"])
            .when(right.isNull() | (left["t"] == right["t"]), left["x"])
            .otherwise(left["x"] + slope * (F.col(t) - left["t"]))
        )

    rest = [c for c in df.columns if c not in features and c != "_bucket"]
    return ends.select(*rest, *[filled(f).alias(f) for f in features])


# ---- statistics -----------------------------------------------------------------------


def fit_moments(df: DataFrame, by: Sequence[str], features: Sequence[str], sample: bool = False) -> DataFrame:
    """mean_<f> and std_<f> per series; population std unless ``sample``."""
    std = F.stddev_samp if sample else F.stddev_pop
    return df.groupBy(*by).agg(
        *[F.avg(f).alias(f"mean_{f}") for f in features], *[std(f).alias(f"std_{f}") for f in features]
    )


def fit_range(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        *[F.min(f).alias(f"min_{f}") for f in features], *[F.max(f).alias(f"max_{f}") for f in features]
    )


def stat_rows(wide: DataFrame, by: Sequence[str], features: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Fitted statistics as rows (by, feature, one column per statistic)."""
    cells = [
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{s}_{f}").alias(s) for s in stats]) for f in features
    ]
    return wide.select(*by, F.inline(F.array(*cells)))


def median_iqr(df: DataFrame, by: Sequence[str], features: Sequence[str], limit: int | None = None) -> DataFrame:
    """Long rows (by, feature, median, iqr), an IQR of 0 taken as 1."""
    long = panel.to_long(df, by, features)
    q = spread.percentiles(long, [*by, "feature"], "x", [0.25, 0.5, 0.75], limit)
    iqr = F.col("q")[2] - F.col("q")[0]
    return q.select(*by, "feature", F.col("q")[1].alias("median"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("iqr"))


def variance_filter(df: DataFrame, by: Sequence[str], features: Sequence[str], least: float = 1e-6) -> DataFrame:
    """Features per series whose sample variance reaches ``least``."""
    wide = df.groupBy(*by).agg(*[F.var_samp(f).alias(f"var_{f}") for f in features])
    return stat_rows(wide, by, features, ["var"]).where(F.col("var") >= least)


def two_valued(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(by, feature, is_binary): at most two distinct values.

    Two passes of plain aggregates: the range, then whether any value lies inside it.
    """
    ranged = spread.lookup_join(df, fit_range(df, by, features), by)
    outer = [
        F.coalesce(
            F.bool_and((F.col(f) == F.col(f"min_{f}")) | (F.col(f) == F.col(f"max_{f}"))), F.lit(True)
        ).alias(f)
        for f in features
    ]
    return panel.to_long(ranged.groupBy(*by).agg(*outer), by, features, "feature", "is_binary")


def static_features(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(by, feature, verdict): kept, dropped (constant) or sentinel (constant 0 or 1)."""
    rows = stat_rows(fit_range(df, by, features), by, features, ["min", "max"])
    verdict = (
        F.when(F.col("min") != F.col("max"), "kept")
        .when(F.col("min").isin(0.0, 1.0), "sentinel")
        .otherwise("dropped")
    )
    return rows.select(*by, "feature", verdict.alias("verdict"))


def binary_groups(flags: DataFrame, feature_groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, grp, is_binary): true when every member feature is two-valued."""
    joined = spread.lookup_join(flags, feature_groups, ["feature"])
    return joined.groupBy(*by, "grp").agg(F.bool_and("is_binary").alias("is_binary"))


# ---- scaling --------------------------------------------------------------------------


def _apply(df: DataFrame, stats: DataFrame, by, features, formula) -> DataFrame:
    """Scaled features; null in a series that has no statistics."""
    rest = [c for c in df.columns if c not in features]
    return spread.lookup_join(df, stats, by, "left").select(*rest, *[formula(f).alias(f) for f in features])


def scale_standard(
    df: DataFrame, stats: DataFrame, by: Sequence[str], features: Sequence[str], floor: float | None = None
) -> DataFrame:
    """(x - mean) / std; a std of 0 (or under ``floor``) counts as 1."""

    def z(f):
        std = F.col(f"std_{f}")
        flat = (std == 0) if floor is None else (std < floor)
        return (F.col(f) - F.col(f"mean_{f}")) / F.when(flat, 1.0).otherwise(std)

    return _apply(df, stats, by, features, z)


def scale_minmax(df: DataFrame, stats: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Range to [0, 1], a constant feature to 0."""

    def unit(f):
        low, high = F.col(f"min_{f}"), F.col(f"max_{f}")
        return (F.col(f) - low) / F.when(high == low, 1.0).otherwise(high - low)

    return _apply(df, stats, by, features, unit)


def scale_binary(df: DataFrame, stats: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Two-valued features to 0/1 by the training range; unseen test values may leave it."""

    def remap(f):
        low, high = F.col(f"min_{f}"), F.col(f"max_{f}")
        return F.when(high > low, (F.col(f) - low) / (high - low)).otherwise(F.col(f))

    return _apply(df, stats, by, features, remap)


def scale_robust(df: DataFrame, stats: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(x - median) / IQR with the long statistics of :func:`median_iqr`."""
    wide = stats.groupBy(*by).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"median_{f}") for f in features],
        *[F.max(F.when(F.col("feature") == f, F.col("iqr"))).alias(f"iqr_{f}") for f in features],
    )
    return _apply(df, wide, by, features, lambda f: (F.col(f) - F.col(f"median_{f}")) / F.col(f"iqr_{f}"))


# ---- splits ---------------------------------------------------------------------------


def split_contiguous(df: DataFrame, by: Sequence[str], share: float = 0.3, rule: str = "tail", t: str = "t") -> DataFrame:
    """Mark train/val along time.

    ``tail``: the last max(1, round(n * share)) steps are val. ``head``: the first
    int(n * (1 - share)) steps are train.
    """
    sizes = df.groupBy(*by).agg((F.max(t) + 1).alias("_n"))
    n = F.col("_n")
    if rule == "tail":
        cut = n - F.greatest(F.lit(1).cast("bigint"), F.bround(n * F.lit(share), 0).cast("bigint"))
    else:
        cut = F.floor(n * F.lit(1 - share))
    out = spread.lookup_join(df, sizes, by)
    return out.select(*df.columns, F.when(F.col(t) < cut, "train").otherwise("val").alias("split"))


def split_random(
    df: DataFrame, by: Sequence[str], key: str, shares: dict[str, float], seed: int = 42, limit: int | None = None
) -> DataFrame:
    """Exact shares per series in hashed order; ``shares`` names the held-out parts in order.

    Each held-out part gets the rows up to ceil(n * cumulative share); the rest is train.
    """
    by = list(by)
    drawn = df.withColumn("_draw", draws.hash_bits(*[F.col(c) for c in by], F.col(key), F.lit(seed)))
    ordered = spread.row_index(drawn, by, ["_draw", key], "_pos", limit, df.select(*by))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    part, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        inside = F.col("_pos") < F.ceil(F.round(F.col("_n") * F.lit(upto), 9))
        part = F.when(inside, name) if part is None else part.when(inside, name)
    out = spread.lookup_join(ordered, sizes, by)
    return out.select(*df.columns, part.otherwise("train").alias("split"))
