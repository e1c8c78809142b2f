"""Writers of fitted statistics, models, trials and report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidewatch.operators import spread


def scratch(spark, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{spread.shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"


def through_parquet(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def save_fitted(tables: dict[str, DataFrame], path: str) -> None:
    """One parquet folder per fitted table (scaler, groups, ecdf, thresholds)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_fitted(spark, path: str, names) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def append_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").partitionBy("study").parquet(path)


def load_trials(spark, path: str, study: str | None = None) -> DataFrame:
    trials = spark.read.parquet(path)
    return trials if study is None else trials.where(trials.study == study)
