"""Second moments of all stride-1 windows of a panel, and their leading directions, without building a window.

A window of ``length`` rows of F features is a vector of length x F values. If series went on with zeros at both ends, the second
moments of their windows would depend on the lag between two positions only: F x F products
G(tau) = sum x(t) x(t + tau)'. What is too much are the windows that reach over an end, and these consist of the
first and last ``length`` - 1 rows of each series. So the covariance times a block of vectors is made of the lag products,
those end rows and the mean; the matrix itself, (length x F)^2 values, is never formed. The leading directions
come from block Krylov spaces, which only ask for such products.

One pass over the panel adds up the lag products of all feature groups, bucket by bucket, with partial sums per task. End
rows are held by the driver up to ``EDGE_VALUES`` values; beyond that they stay a table, and each
product is a job over it.

Series shorter than a window have no window and are left out. Features must hold no nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import spread

# Values of end rows that the driver holds.
EDGE_VALUES = 4_000_000
# Values of one bucket, and rows that a task multiplies at once.
BUCKET_VALUES, ROWS = 8_000_000, 50_000
# Blocks of one Krylov space, and spaces tried.
BLOCKS, ROUNDS = 4, 200
# Residual of a direction, against the greatest variance.
TOLERANCE = 1e-12

Product = Callable[[np.ndarray], np.ndarray]


def leading(product: Product, width: int, k: int, extra: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, and their directions (width x k).

    ``product`` multiplies the matrix with a block of columns. The start is fixed, so that a model can be repeated.
    """
    k = min(k, width)
    size = min(width, k + extra)
    if width <= BLOCKS * size:
        # The whole matrix is no larger than a Krylov space.
        values, vectors = np.linalg.eigh(_even(product(np.eye(width))))
        return values[::-1][:k], vectors[:, ::-1][:, :k]
    block = np.linalg.qr(np.random.default_rng(0).standard_normal((width, size)))[0]
    for _ in range(ROUNDS):
        space, images = [block], [product(block)]
        for _ in range(BLOCKS - 1):
            held = np.hstack(space)
            fresh = images[-1] - held @ (held.T @ images[-1])
            # Twice is enough against rounding.
            fresh -= held @ (held.T @ fresh)
            fresh, r = np.linalg.qr(fresh)
            # Columns that add nothing are rounding errors.
            fresh = fresh[:, np.abs(np.diag(r)) > 1e-14 * max(1e-300, np.abs(images[0]).max())]
            if not fresh.shape[1]:
                break
            space.append(fresh)
            images.append(product(fresh))
        held, image = np.hstack(space), np.hstack(images)
        values, turn = np.linalg.eigh(_even(held.T @ image))
        values, turn = values[::-1][:size], turn[:, ::-1][:, :size]
        gone = np.linalg.norm(image @ turn - (held @ turn) * values, axis=0)[:k]
        block = np.linalg.qr(held @ turn)[0]
        if (gone <= TOLERANCE * max(abs(values[0]), 1e-300)).all():
            break
    return values[:k], block[:, :k]


def _even(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


@dataclass(frozen=True)
class WindowMoments:
    """What the windows of one feature group add up to: their number, mean and covariance as a product."""

    length: int
    count: int
    mean: np.ndarray
    products: np.ndarray
    edges: Product
    shift: np.ndarray

    def covariance(self, block: np.ndarray) -> np.ndarray:
        """The covariance of the windows times a block of columns."""
        length, width = self.length, self.products.shape[1]
        v = block.reshape(length, width, -1)
        out = np.matmul(self.products[0], v)
        for tau in range(1, length):
            out[: length - tau] += np.matmul(self.products[tau], v[tau:])
            out[tau:] += np.matmul(self.products[tau].T, v[: length - tau])
        whole = out.reshape(length * width, -1) - self.edges(block)
        whole -= self.count * np.outer(self.mean, self.mean @ block)
        return whole / max(1, self.count - 1)

    def directions(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean window, k variances, k directions as columns)."""
        values, vectors = leading(self.covariance, len(self.mean), k)
        return self.mean + np.tile(self.shift, self.length), values, vectors


def edge_product(heads: np.ndarray, tails: np.ndarray, block: np.ndarray, length: int) -> np.ndarray:
    """The zero-padded windows over the ends of series, times their transpose, times a block.

    ``heads`` and ``tails`` are the first and last length - 1 rows of each series.
    """
    out, (many, _, width) = np.zeros_like(block), heads.shape
    for j in range(1, length):
        rest = (length - j) * width
        head, tail = heads[:, : length - j].reshape(many, rest), tails[:, j - 1 :].reshape(many, rest)
        out[j * width :] += head.T @ (head @ block[j * width :])
        out[:rest] += tail.T @ (tail @ block[:rest])
    return out


def window_moments(
    df: DataFrame, by: Sequence[str], groups: Mapping[int, Sequence[str]], length: int, size: int | None = None
) -> dict[int, WindowMoments]:
    """Moments of all windows of all series, for each feature group; ``t`` is dense within a series."""
    by, spark = list(by), df.sparkSession
    columns = sorted({c for cols in groups.values() for c in cols})
    place = {g: [columns.index(c) for c in cols] for g, cols in groups.items()}
    width = len(columns)
    first = df.groupBy(*by).agg(F.min("t").alias("_first"), (F.max("t") - F.min("t") + 1).alias("_n"))
    sizes = spread.durable(first.where(F.col("_n") >= length))
    series, count = sizes.agg(F.count("*"), F.sum(F.col("_n") - length + 1)).first()
    if not series:
        raise ValueError("no series is as long as a window")
    # Any constant may be taken off; near the mean sums lose least.
    shift = np.array([float(x or 0.0) for x in df.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()])
    values = F.array(*[F.col(c).cast("double") - F.lit(float(s)) for c, s in zip(columns, shift, strict=True)])
    placed = spread.lookup_join(df.select(*by, "t", *columns), sizes, by)
    rows = placed.select(*by, (F.col("t") - F.col("_first")).alias("t"), "_n", values.alias("x"))
    sums = _lag_sums(rows, by, place, width, length, size)
    ends = rows.where((F.col("t") < length - 1) | (F.col("t") > F.col("_n") - length))
    from_end = F.col("t") - F.col("_n") + F.lit(length - 1)
    if 2 * series * (length - 1) * width <= EDGE_VALUES:
        heads, tails = _held(ends, by, length, width, from_end)
        head_sum, tail_sum = heads.sum(axis=0), tails.sum(axis=0)
        near = {g: _held_product(heads[:, :, p], tails[:, :, p], length) for g, p in place.items()}
    else:
        stored = _stored_ends(ends, by, length)
        head_sum, tail_sum = _end_sums(stored, length, width)
        near = {g: _job_product(stored, p, length, width) for g, p in place.items()}
    # At position p every row stands once, but for those of windows over an end.
    over = np.zeros((length, width))
    over[1:] += np.cumsum(head_sum, axis=0)
    over[:-1] += np.cumsum(tail_sum[::-1], axis=0)[::-1]
    out = {}
    for g, p in place.items():
        mean = ((sums[g, -1][None, :] - over[:, p]) / count).ravel()
        products = np.stack([sums[g, tau].reshape(len(p), len(p)) for tau in range(length)])
        out[g] = WindowMoments(length, int(count), mean, products, near[g], shift[p])
    return out


def _lag_sums(
    rows: DataFrame, by: list[str], place: Mapping[int, list[int]], width: int, length: int, size: int | None
) -> dict[tuple[int, int], np.ndarray]:
    """(group, tau) -> the products of that lag; at tau -1 the sums of the rows."""
    size = size or max(length, min(spread.BUCKET, BUCKET_VALUES // width))
    halo = spread.with_halo(rows, 0, length - 1, size=size)
    dealt = halo.select(F.xxhash64(*by, "_bucket").alias("g"), "t", "_home", "x").repartition("g").sortWithinPartitions("g", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(g, tau): np.zeros(len(p) ** (2 if tau >= 0 else 1)) for g, p in place.items() for tau in range(-1, length)}
        group, home, x = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, width))

        def add(upto: int) -> None:
            """Products of the rows before ``upto`` with those that follow them."""
            for g, p in place.items():
                part = np.ascontiguousarray(x[:, p])
                own = part[:upto] * home[:upto, None]
                sums[g, -1] += own.sum(axis=0)
                for tau in range(min(length, len(x))):
                    m = min(upto, len(x) - tau)
                    a = own[:m] * (group[:m] == group[tau : tau + m])[:, None]
                    sums[g, tau] += (a.T @ part[tau : tau + m]).ravel()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                cut = batch.slice(at, ROWS)
                group = np.concatenate([group, cut.column(0).to_numpy()])
                home = np.concatenate([home, cut.column(2).to_numpy(zero_copy_only=False)])
                x = np.concatenate([x, cut.column(3).flatten().to_numpy().reshape(-1, width)])
                done = len(x) - length + 1
                if done > 0:
                    add(done)
                    group, home, x = group[done:], home[done:], x[done:]
        add(len(x))
        keys = list(sums)
        arrays = [
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([sums[k] for k in keys], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["grp", "tau", "v"])

    parts = dealt.mapInArrow(run, "grp int, tau int, v array<double>").select("grp", "tau", F.posexplode("v").alias("at", "v"))
    out = {(g, tau): np.zeros(len(p) ** (2 if tau >= 0 else 1)) for g, p in place.items() for tau in range(-1, length)}
    cells = parts.groupBy("grp", "tau", "at").agg(F.sum("v").alias("v")).groupBy("grp", "tau")
    # One row for each group and lag: length times the squares of the groups' widths in all.
    for r in cells.agg(F.array_sort(F.collect_list(F.struct("at", "v")))["v"].alias("v")).collect():
        out[r.grp, r.tau][:] = r.v
    return out


def _held(ends: DataFrame, by: list[str], length: int, width: int, from_end) -> tuple[np.ndarray, np.ndarray]:
    def rows(df: DataFrame) -> np.ndarray:
        table = df.orderBy(*by, "t").select("x").toArrow()
        flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(-1, max(1, length - 1), width) if length > 1 else np.zeros((0, 0, width))

    return rows(ends.where(F.col("t") < length - 1)), rows(ends.where(from_end >= 0))


def _held_product(heads: np.ndarray, tails: np.ndarray, length: int) -> Product:
    return lambda block: edge_product(heads, tails, block, length)


def _stored_ends(ends: DataFrame, by: list[str], length: int) -> DataFrame:
    """One row per series: its first and last length - 1 rows, flat."""
    head = F.when(F.col("t") < length - 1, F.struct("t", "x"))
    tail = F.when(F.col("t") > F.col("_n") - length, F.struct("t", "x"))
    both = ends.groupBy(*by).agg(
        *[F.flatten(F.array_sort(F.collect_list(c))["x"]).alias(n) for n, c in (("head", head), ("tail", tail))]
    )
    return spread.durable(both.select("head", "tail"))


def _end_arrays(batch: pa.RecordBatch, length: int, width: int) -> list[np.ndarray]:
    return [batch.column(i).flatten().to_numpy().reshape(batch.num_rows, length - 1, width) for i in (0, 1)]


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Arrays of tasks, added up by Spark."""
    out = np.zeros(shape[0] * shape[1])
    for r in parts.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out.reshape(shape)


def _end_sums(stored: DataFrame, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, length - 1, width))
        for batch in batches:
            for i, rows in enumerate(_end_arrays(batch, length, width)):
                total[i] += rows.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

    both = _summed(stored.mapInArrow(run, "v array<double>"), (2, (length - 1) * width)).reshape(2, length - 1, width)
    return both[0], both[1]


def _job_product(stored: DataFrame, place: list[int], length: int, width: int) -> Product:
    def product(block: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(block)
            for batch in batches:
                heads, tails = (rows[:, :, place] for rows in _end_arrays(batch, length, width))
                total += edge_product(heads, tails, block, length)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

        return _summed(stored.mapInArrow(run, "v array<double>"), block.shape)

    return product


def row_product(wins: DataFrame, vec: str, mean: np.ndarray) -> Product:
    """The covariance of stored vectors times a block, one job for each product."""

    def product(block: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(block)
            for batch in batches:
                m = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, len(mean)) - mean
                total += m.T @ (m @ block)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

        return _summed(wins.select(F.col(vec).cast("array<double>")).mapInArrow(run, "v array<double>"), block.shape)

    return product
