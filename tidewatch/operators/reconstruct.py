"""Window reconstruction: linear autoencoders (PCA), one per feature group, or a user's model."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import losses
from tidewatch.operators import lagged, windows

# Widest vector whose covariance one driver should hold; wider ones go through products with it.
MAX_WIDTH = 4000


@dataclass(frozen=True)
class WindowPca:
    """A fitted linear autoencoder: the mean window and the leading directions (width x k)."""

    mean: np.ndarray
    basis: np.ndarray

    @staticmethod
    def fit(wins: DataFrame, k: int, vec: str = "vec") -> "WindowPca":
        """Fit on given vectors (all windows of a panel: ``fit_panel``, which builds none of them).

        Means and covariance are tree-aggregated by Spark; beyond ``MAX_WIDTH`` values the covariance is not
        formed, and each of its products is one job over the vectors.
        """
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer

        data = wins.select(array_to_vector(vec).alias("features"))
        mean = data.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
        if len(mean) > MAX_WIDTH:
            return WindowPca(mean, lagged.leading(lagged.row_product(wins, vec, mean), len(mean), k)[1])
        fitted = PCA(k=min(k, len(mean)), inputCol="features", outputCol="z").fit(data)
        return WindowPca(mean, fitted.pc.toArray())

    @staticmethod
    def fit_panel(
        df: DataFrame, by: Sequence[str], columns: Sequence[str], length: int, k: int, size: int | None = None
    ) -> "WindowPca":
        """Fit on all stride-1 windows of a panel from its lag products: the same model as ``fit``, whatever the width."""
        return GroupedPca.fit_panel(df, by, {0: columns}, length, k, size).models[0]

    def transform(self, wins: DataFrame, vec: str = "vec", out: str = "xhat") -> DataFrame:
        """Add the reconstruction of every window, Arrow batch by Arrow batch."""
        mean, basis = self.mean, self.basis

        @F.pandas_udf("array<double>")
        def rebuild(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = np.stack(x.to_numpy())
            return pd.Series(list((m - mean) @ basis @ basis.T + mean))

        return wins.withColumn(out, rebuild(F.col(vec)))

    def to_rows(self, spark: SparkSession) -> DataFrame:
        """(position, mean, loadings): the model as a small table."""
        rows = [(i, float(m), [float(v) for v in b]) for i, (m, b) in enumerate(zip(self.mean, self.basis))]
        return spark.createDataFrame(rows, "position int, mean double, loadings array<double>")

    @staticmethod
    def from_rows(df: DataFrame) -> "WindowPca":
        """The stored model whole: one row per value of a window."""
        rows = df.orderBy("position").collect()
        return WindowPca(np.array([r["mean"] for r in rows]), np.array([r["loadings"] for r in rows]))


@dataclass(frozen=True)
class GroupedPca:
    """One linear autoencoder per feature group over the columns ``win_<g>``."""

    models: Mapping[int, WindowPca]

    @staticmethod
    def fit(wins: DataFrame, groups: Sequence[int], k: int) -> "GroupedPca":
        flat = {g: windows.flatten_windows(wins, f"win_{g}", "vec") for g in groups}
        return GroupedPca({g: WindowPca.fit(df, k) for g, df in flat.items()})

    @staticmethod
    def fit_panel(
        df: DataFrame, by: Sequence[str], groups: Mapping[int, Sequence[str]], length: int, k: int, size: int | None = None
    ) -> "GroupedPca":
        """The models of all groups from one pass over the panel."""
        models = {}
        for g, moments in lagged.window_moments(df, by, groups, length, size).items():
            mean, _, basis = moments.directions(k)
            models[g] = WindowPca(mean, basis)
        return GroupedPca(models)

    def transform(self, wins: DataFrame) -> DataFrame:
        """Add x_<g> and xhat_<g> for every group."""
        out = wins
        for g, model in sorted(self.models.items()):
            out = model.transform(windows.flatten_windows(out, f"win_{g}", f"x_{g}"), f"x_{g}", f"xhat_{g}")
        return out


def pca_errors(wins: DataFrame, model: WindowPca, keys: Sequence[str]) -> DataFrame:
    """(keys, score): mean squared reconstruction error per window."""
    both = model.transform(wins.select(*keys, "vec"))
    return both.select(*keys, losses.mse(F.col("vec"), F.col("xhat")).alias("score"))


def external(
    wins: DataFrame, predict: Callable, schema: str, shared: object | None = None
) -> DataFrame:
    """Run a user's batch model over windows: ``predict(batches[, weights])`` as in mapInPandas.

    ``shared`` (weights, of a size the user vouches for) is broadcast once.
    """
    if shared is None:
        return wins.mapInPandas(predict, schema)
    held = wins.sparkSession.sparkContext.broadcast(shared)
    return wins.mapInPandas(lambda batches: predict(batches, held.value), schema)
