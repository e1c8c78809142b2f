"""The whole feature selection of many series at once, each with features of its own.

Stage 0 sorts out constant features, 1a measures lagged rank similarity, 1b clusters what is redundant, 2 asks how much the medoids
of the clusters matter to a linear model of the series, 3 makes groups. A series has the features that hold a value in it;
tables of (series, feature) and of the thresholds of each series go through all stages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import lagged, prepare, select, spread


def own_features(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(by, feature, verdict, is_binary) of the features that have a value in a series."""
    by = list(by)
    verdicts = prepare.static_features(df, by, features)
    flags = prepare.two_valued(df, by, features)
    there = prepare.stat_rows(prepare.fit_range(df, by, features), by, features, ["min"]).where("min IS NOT NULL")
    both = spread.join_null_safe(verdicts, flags, [*by, "feature"], many=True)
    return spread.join_null_safe(both, there.select(*by, "feature"), [*by, "feature"], "left_semi", many=True)


class _Shape:
    """Where the sums of a series of ``width`` features stand in one array; all of them add up over blocks."""

    def __init__(self, length: int, width: int):
        ends = (length - 1) * width
        sizes = [width, length * width * width, ends, ends, width * length * length]
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        self.shapes = [(width,), (length, width, width), (length - 1, width), (length - 1, width), (width, length, length)]

    def parts(self, sums: np.ndarray) -> list[np.ndarray]:
        return [sums[a:b].reshape(s) for a, b, s in zip(self.edges, self.edges[1:], self.shapes, strict=False)]


def block_sums(x: np.ndarray, t: np.ndarray, own: int, cut: int, n: int, length: int, repeats: int, salt: int) -> np.ndarray:
    """What rows of one block (the first ``own`` of them are its own) add to the sums of their series.

    Windows before ``cut`` are learned from: row sums, lag products and end rows of the first cut + length - 1
    steps. For the windows from ``cut`` on: per feature, products of the changes that shuffled blocks make.
    """
    width = x.shape[1]
    shape = _Shape(length, width)
    out = np.zeros(shape.edges[-1])
    total, products, head, tail, moves = shape.parts(out)
    last = cut + length - 1
    learned = x[t < last]
    mine = min(own, len(learned))
    total += learned[:mine].sum(axis=0)
    for tau in range(min(length, len(learned))):
        m = min(mine, len(learned) - tau)
        products[tau] += learned[:m].T @ learned[tau : tau + m]
    for rows, at in ((head, t[:own]), (tail, t[:own] - (last - length + 1))):
        on = np.flatnonzero((at >= 0) & (at < length - 1) & (t[:own] < last))
        rows[at[on]] += x[on]
    firsts = np.flatnonzero((t[:own] >= cut) & (t[:own] <= n - length))
    if len(firsts):
        draws = select._mixed(t[firsts].astype(np.uint64) + np.uint64(salt))
        views = np.lib.stride_tricks.sliding_window_view(x, length, axis=0)[firsts]
        for f in range(width):
            track = views[:, f, :]
            for r in range(repeats):
                moved = np.take_along_axis(track, select.block_order(draws, length, f, r), axis=1) - track
                moves[f] += moved.T @ moved
    return out


def importances(sums: np.ndarray, width: int, cut: int, n: int, length: int, k: int, repeats: int) -> np.ndarray:
    """The rise of the error per feature, from the sums of a series."""
    total, products, head, tail, moves = _Shape(length, width).parts(sums)
    over = np.zeros((length, width))
    over[1:] += np.cumsum(head, axis=0)
    over[:-1] += np.cumsum(tail[::-1], axis=0)[::-1]
    mean = ((total - over) / cut).ravel()

    def edges(block: np.ndarray) -> np.ndarray:
        return lagged.edge_product(head[None], tail[None], block, length)

    basis = lagged.WindowMoments(length, cut, mean, products, edges, np.zeros(width)).directions(k)[2]
    windows = n - length + 1 - cut
    rise = [np.sum((moves[f] @ basis[f::width]) * basis[f::width]) for f in range(width)]
    return np.array(rise) / (repeats * windows * length * width)


def own_importance(
    df: DataFrame, by: Sequence[str], members: DataFrame, features: Sequence[str], length: int, k: int = 6,
    share: float = 0.3, repeats: int = 3, size: int | None = None, seed: int = 42,
) -> DataFrame:
    """(by, feature, importance) for the features that ``members`` (by, feature) names per series.

    A series' windows of its own features, scaled by median and interquartile range, are split along time. The
    first part gives its leading directions through lag products; on the rest the blocks of one feature at a time are
    shuffled. Since the model is linear, the error rises by the squared part of the change that lies in those directions, so
    that a block of rows needs to give sums only. A series with fewer than two windows has no model: null.
    """
    by, features = list(by), list(features)
    place = F.create_map(*[v for i, f in enumerate(features) for v in (F.lit(f), F.lit(i))])
    scales = spread.join_null_safe(
        members.select(*by, "feature"), prepare.median_iqr(df, by, features), [*by, "feature"], many=True
    )
    at = place[F.col("feature")].alias("at")
    entry = F.struct(at, F.col("median").cast("double").alias("median"), F.col("iqr").cast("double").alias("iqr"))
    used = scales.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    used = used.select(*by, *[F.col(f"e.{c}").alias(n) for c, n in (("at", "use"), ("median", "middle"), ("iqr", "range"))])
    sizes = df.groupBy(*by).agg((F.max("t") + 1).alias("n"))
    windows_ = F.col("n") - length + 1
    cut = (windows_ - F.greatest(F.lit(1).cast("bigint"), F.bround(windows_ * F.lit(share), 0).cast("bigint"))).alias("cut")
    salt = F.xxhash64(*by, F.lit(seed)).alias("salt")
    context = spread.join_null_safe(used, sizes, by, many=True).select(*by, "use", "middle", "range", "n", cut, salt)
    context = spread.durable(context)
    fit = context.where("cut >= 1")

    size = size or max(length, min(spread.BUCKET, lagged.BUCKET_VALUES // len(features)))
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("x")
    blocks = spread.with_halo(df.select(*by, "t", values), 0, length - 1, size=size).drop("_home")
    keys = [*by, "_bucket"]
    last = F.floor((F.col("n") - 1) / F.lit(size))
    placed = fit.withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in by)

    def add(key: tuple, block: pa.Table, own: pa.Table) -> pa.Table:
        rows = []
        if len(block) and len(own):
            t = block["t"].to_numpy()
            order = np.argsort(t)
            c = {name: own[name][0].as_py() for name in ("use", "n", "cut", "middle", "range", "salt")}
            x = (select._matrix(block["x"], len(features))[order][:, c["use"]] - c["middle"]) / c["range"]
            mine = int((t // size == key[-1].as_py()).sum())
            sums = block_sums(
                np.ascontiguousarray(x), t[order], mine, c["cut"], c["n"], length, repeats, c["salt"] & (2**63 - 1)
            )
            rows = [sums]
        columns = {c: pa.array([k.as_py()] * len(rows), k.type) for c, k in zip(by, key)}
        return pa.table(columns | {"sums": pa.array(rows, pa.list_(pa.float64()))})

    parts = blocks.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(add, f"{kinds}, sums array<double>")
    names = F.array(*[F.lit(f) for f in features])
    at = spread.lookup_join(parts, fit.select(*by, "use", "n", "cut"), by)
    group = F.xxhash64(*by)
    dealt = at.select(*by, group.alias("g"), "use", "n", "cut", "sums").repartition("g").sortWithinPartitions("g", *by)

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a series follow each other: their sums are added one by one."""
        last, held, sums = None, None, None

        def close() -> pa.RecordBatch:
            use, n, cut = (held.column(c)[0].as_py() for c in ("use", "n", "cut"))
            found = importances(sums, len(use), cut, n, length, k, repeats)
            columns = [held.column(c).take(pa.array([0] * len(use))) for c in by]
            return pa.RecordBatch.from_arrays([*columns, pa.array(use, pa.int32()), pa.array(found)], [*by, "at", "importance"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                key = [row.column(c)[0].as_py() for c in by]
                if key != last:
                    if last is not None:
                        yield close()
                    last, held, sums = key, row, 0.0
                sums = sums + row.column("sums").flatten().to_numpy()
        if last is not None:
            yield close()

    scored = dealt.mapInArrow(model, f"{kinds}, at int, importance double")
    scored = scored.select(*by, F.get(names, F.col("at")).alias("feature"), "importance")
    found = spread.join_null_safe(members.select(*by, "feature"), scored, [*by, "feature"], "left", many=True)
    return found.select(*by, "feature", "importance")


def select_features(
    df: DataFrame, by: Sequence[str], features: Sequence[str], length: int, max_lag: int | None = None,
    decay: float | None = None, k: int = 6, thresholds: DataFrame | None = None, size: int | None = None,
) -> DataFrame:
    """(by, feature, grp, kind) for every feature that varies, or is constant 0 or 1, in its series.

    ``thresholds`` (by, corr_threshold, importance_percentile) are by default stricter for series of mostly
    two-valued features (``select.adaptive_thresholds``). A feature without any value is no feature of the series; gaps
    are to be filled before.
    """
    by, features = list(by), list(features)
    own = spread.durable(own_features(df, by, features))
    if thresholds is None:
        thresholds = select.adaptive_thresholds(own, by)
    thresholds = spread.durable(thresholds)
    kept = spread.durable(own.where("verdict = 'kept'").select(*by, "feature"))
    filled = spread.durable(df.select(*by, "t", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]))
    sim = select.lagged_spearman(filled, by, features, length if max_lag is None else max_lag, decay, size=size)
    bounds = spread.lookup_join(kept, thresholds.select(*by, "corr_threshold"), by)
    clusters = spread.durable(select.cluster_members(bounds, sim, by, features))
    medoids = clusters.select(*by, F.col("medoid").alias("feature")).distinct()
    importance = own_importance(filled, by, medoids, features, length, k, size=size)
    # Without a model every cluster of a series counts alike.
    ranked = select.cluster_importance(clusters, importance.fillna(0.0, ["importance"]), by)
    sentinels = own.where("verdict = 'sentinel'").select(*by, "feature")
    return select.assign_groups(clusters, spread.durable(ranked), by, thresholds, sentinels)
