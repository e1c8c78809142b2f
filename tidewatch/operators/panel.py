"""Panel shapes: wide (one column per feature), long, and array rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import spread


def clean_number(c: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def to_long(df: DataFrame, keep: Sequence[str], features: Sequence[str], name="feature", value="x") -> DataFrame:
    return df.unpivot(list(keep), list(features), name, value)


def to_array(df: DataFrame, keep: Sequence[str], features: Sequence[str], name="values") -> DataFrame:
    return df.select(*keep, F.array(*features).alias(name))


def from_array(df: DataFrame, keep: Sequence[str], array: str, width: int, prefix="f") -> DataFrame:
    """One double column per array position."""
    cols = [F.get(F.col(array), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(width)]
    return df.select(*keep, *cols)


def regular_grid(df: DataFrame, by: Sequence[str], t: str = "t", size: int | None = None) -> DataFrame:
    """Every step between the first and last t of a series, rebased to 0; absent steps are null rows."""
    by, size = list(by), size or spread.BUCKET
    bounds = df.groupBy(*by).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    blocks = bounds.withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size)))
    ).repartition(*by, "_block")
    first = F.greatest(F.col("_lo"), F.col("_block") * size)
    last = F.least(F.col("_hi"), (F.col("_block") + 1) * size - 1)
    steps = blocks.select(*by, "_lo", F.explode(F.sequence(first, last)).alias(t))
    rest = [c for c in df.columns if c not in by and c != t]
    return steps.join(df, [*by, t], "left").select(*by, (F.col(t) - F.col("_lo")).alias(t), *rest)


def group_columns(df: DataFrame, keep: Sequence[str], groups: dict[int, Sequence[str]]) -> DataFrame:
    """One array column per feature group, in group order."""
    return df.select(*keep, *[F.array(*cols).alias(f"grp_{g}") for g, cols in sorted(groups.items())])


def group_rows(long: DataFrame, feature_groups: DataFrame, on: Sequence[str] = ("feature",)) -> DataFrame:
    """Long rows with the group of their feature; features in no group are left out."""
    return spread.lookup_join(long, feature_groups, list(on))
