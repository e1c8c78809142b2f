"""Sliding windows, differences, lags, lattice averages, segments and label alignment.

All take panels whose ``t`` is dense from 0 within each series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import spread


def sliding(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    length: int,
    t: str = "t",
    size: int | None = None,
    name: str = "win",
) -> DataFrame:
    """All stride-1 windows: (by, w, t_end, win) with win = array of rows, each an array."""
    if length < 1:
        raise ValueError("window length must be positive")
    halo = spread.with_halo(df.select(*by, t, *columns), length - 1, 0, t, size)
    frame = spread.bucket_frame(by, t).rowsBetween(-(length - 1), 0)
    row = F.array(*[F.col(c).cast("double") for c in columns])
    wins = halo.withColumn(name, F.collect_list(row).over(frame)).where(F.col("_home") & (F.size(name) == length))
    return wins.select(*by, (F.col(t) - (length - 1)).alias("w"), F.col(t).alias("t_end"), name)


def sliding_grouped(
    df: DataFrame,
    by: Sequence[str],
    groups: dict[int, Sequence[str]],
    length: int,
    t: str = "t",
    size: int | None = None,
) -> DataFrame:
    """One window column ``win_<g>`` per feature group, cut from one pass over the rows."""
    if not groups or any(not cols for cols in groups.values()):
        raise ValueError("every feature group needs at least one feature")
    order = sorted(groups)
    columns = [c for g in order for c in groups[g]]
    wins = sliding(df, by, columns, length, t, size)

    def cut(start: int, width: int) -> Column:
        return F.transform("win", lambda row: F.slice(row, start, width))

    out, at = [], 1
    for g in order:
        out.append(cut(at, len(groups[g])).alias(f"win_{g}"))
        at += len(groups[g])
    return wins.select(*by, "w", "t_end", *out)


def require_windows(df: DataFrame, by: Sequence[str], length: int, t: str = "t") -> DataFrame:
    """df itself, after checking that every series is at least one window long."""
    short = df.groupBy(*by).agg((F.max(t) + 1).alias("n")).where(F.col("n") < length)
    if short.take(1):
        raise ValueError(f"some series are shorter than the window length {length}")
    return df


def flatten_windows(wins: DataFrame, name: str = "win", out: str = "vec") -> DataFrame:
    return wins.withColumn(out, F.flatten(name))


def keep_windows(wins: DataFrame, selected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Windows whose start is listed."""
    return wins.join(selected.select(*by, "w"), [*by, "w"], "left_semi")


def diff(df: DataFrame, by: Sequence[str], features: Sequence[str], t: str = "t", size: int | None = None) -> DataFrame:
    """First differences; the first row of a series has none and is dropped."""
    frame = lambda w: {f"_d_{f}": F.col(f) - F.lag(f).over(w) for f in features}
    out = spread.windowed(df, by, 1, 0, build=frame, t=t, size=size).where(F.col(t) > 0)
    rest = [c for c in df.columns if c not in features]
    return out.select(*rest, *[F.col(f"_d_{f}").alias(f) for f in features])


def lag_align(
    df: DataFrame, by: Sequence[str], x: str, y: str, max_lag: int, t: str = "t", size: int | None = None
) -> DataFrame:
    """Rows (by, tau, t, x at t, y at t + tau) for every lag in [-L, L], L at most half the series."""
    ahead = lambda w: {
        "_ys": F.collect_list(F.struct(F.col(t).alias("ty"), F.col(y).alias("y"))).over(
            w.rowsBetween(-max_lag, max_lag)
        )
    }
    base = df.select(*by, t, F.col(x).alias("x"), *([F.col(y)] if y != x else [])).withColumn(y, F.col(x if y == x else y))
    near = spread.windowed(base, by, max_lag, max_lag, build=ahead, t=t, size=size)
    sizes = df.groupBy(*by).agg((F.max(t) + 1).alias("_n"))
    near = spread.lookup_join(near, sizes, by)
    pairs = near.select(*by, t, "x", "_n", F.inline("_ys"))
    tau = F.col("ty") - F.col(t)
    return pairs.where(F.abs(tau) <= F.floor(F.col("_n") / 2)).select(*by, tau.alias("tau"), t, "x", "y")


def lattice(df: DataFrame, by: Sequence[str], score: str, delay: int, length: int, w: str = "w") -> DataFrame:
    """Average overlapping window tails: (by, p, t, score).

    Window w gives the last ``delay`` of its per-step scores to p = w .. w + delay - 1, which
    is time p + length - delay.
    """
    tails = df.select(*by, w, F.posexplode(F.slice(score, -delay, delay)).alias("_j", "_s"))
    out = tails.groupBy(*by, (F.col(w) + F.col("_j")).alias("p")).agg(F.avg("_s").alias("score"))
    return out.select(*by, "p", (F.col("p") + length - delay).alias("t"), "score")


def run_start(y: str, w) -> Column:
    """1 on the first row of a run of ones, over a bucket window."""
    return ((F.col(y) == 1) & (F.coalesce(F.lag(y).over(w), F.lit(0)) != 1)).cast("int")


def number_segments(
    df: DataFrame, by: Sequence[str], y: str = "y", t: str = "t", size: int | None = None
) -> DataFrame:
    """Add seg_id: the number of runs of ones that have started up to this row."""
    starts = spread.windowed(df, by, 1, 0, build=lambda w: {"_start": run_start(y, w)}, t=t, size=size)
    return spread.bucket_running(starts, by, {"seg_id": F.col("_start")}, t=t, size=size).drop("_start")


def segments(df: DataFrame, by: Sequence[str], y: str = "y", t: str = "t", size: int | None = None) -> DataFrame:
    """Runs of ones as inclusive intervals: (by, seg_id, start_t, end_t)."""
    numbered = number_segments(df.select(*by, t, y), by, y, t, size)
    return (
        numbered.where(F.col(y) == 1)
        .groupBy(*by, "seg_id")
        .agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"))
    )


def segment_points(
    segs: DataFrame, lengths: DataFrame, by: Sequence[str], extra: Sequence[str] = (), size: int | None = None
) -> DataFrame:
    """Every position of the segments, clipped to the series: (by, t, extra...).

    ``lengths`` is (by, n). Long segments are cut into blocks before they are spelled out.
    """
    by, size = list(by), size or spread.BUCKET
    clipped = spread.lookup_join(segs, lengths, by).select(
        *by,
        *extra,
        F.greatest(F.col("start_t"), F.lit(0)).alias("_s"),
        F.least(F.col("end_t"), F.col("n") - 1).alias("_e"),
    ).where(F.col("_s") <= F.col("_e"))
    blocks = clipped.withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_s") / size), F.floor(F.col("_e") / size)))
    ).repartition(*by, "_b", "_s")
    first, last = F.greatest(F.col("_s"), F.col("_b") * size), F.least(F.col("_e"), (F.col("_b") + 1) * size - 1)
    return blocks.select(*by, *extra, F.explode(F.sequence(first, last)).alias("t"))


def paint_segments(
    df: DataFrame, segs: DataFrame, by: Sequence[str], y: str = "y", t: str = "t", size: int | None = None
) -> DataFrame:
    """0/1 label per row of df: 1 inside any segment (ends included).

    No position of a segment is spelled out: it adds one where it starts and takes one off behind its end, and
    a row lies inside where more have started than ended. So a segment is two rows, however long it is.
    """
    by = list(by)
    real = segs.where(F.col("start_t") <= F.col("end_t"))
    for c in by:
        real = real.where(F.col(c).isNotNull())
    edges = real.select(
        *by, F.inline(F.array(
            F.struct((2 * F.col("start_t")).alias("_pos"), F.lit(1).alias("_d")),
            F.struct((2 * F.col("end_t") + 2).alias("_pos"), F.lit(-1).alias("_d")),
        ))
    )
    # Rows stand between the places of the edges: at 2t + 1, behind a start at 2t and before an end at 2t + 2.
    place = F.coalesce((2 * F.col(t) + 1).cast("bigint"), F.lit(-1).cast("bigint"))
    rows = df.withColumns({"_pos": place, "_d": F.lit(0), "_row": F.lit(True)})
    both = rows.unionByName(edges.withColumn("_pos", F.col("_pos").cast("bigint")), allowMissingColumns=True)
    summed = spread.bucket_running(both, by, {"_open": F.col("_d")}, t="_pos", size=size, how="left")
    kept = [c for c in df.columns if c != y]
    inside = F.col(t).isNotNull() & (F.col("_open") > 0)
    return summed.where("_row").select(*kept, inside.cast("int").alias(y))


def window_cover(
    flagged: DataFrame, lengths: DataFrame, by: Sequence[str], length: int, size: int | None = None
) -> DataFrame:
    """Distinct positions covered by flagged windows, clipped to the series: (by, t).

    A position belongs to the last flagged window that starts at or before it, so a window gives the positions up to
    the next flagged one: each position once, whatever the length of a window.
    """
    by = list(by)
    near = spread.lookup_join(flagged.select(*by, "w").distinct(), lengths, by).where(F.col("w") < F.col("n"))
    size = max(size or spread.BUCKET, length)
    halo = spread.with_halo(near, 0, length - 1, "w", size)
    frame = Window.partitionBy(*by, "_bucket").orderBy("w")
    after = F.min("w").over(frame.rangeBetween(1, max(1, length - 1)))
    starts = halo.withColumn("_next", after).where("_home")
    last = F.least(F.col("w") + length - 1, F.col("n") - 1, F.coalesce(F.col("_next") - 1, F.col("n") - 1))
    return starts.select(*by, F.explode(F.sequence("w", last)).alias("t"))


def covered_segments(
    labels: DataFrame, flagged: DataFrame, by: Sequence[str], length: int, y: str = "y", size: int | None = None
) -> DataFrame:
    """Label rows with ``hit`` (a flagged window covers the row) and ``seg_id``.

    The cover is a rolling maximum over the flags: nothing is multiplied by the window length,
    and the starts of the labelled runs come from the same pass.
    """
    by = list(by)
    marks = flagged.select(*by, F.col("w").alias("t"), F.lit(1).alias("_f")).distinct()
    base = labels.select(*by, "t", y).join(marks, [*by, "t"], "left")

    def build(w):
        covering = F.max("_f").over(w.rowsBetween(-(length - 1), 0))
        return {"hit": F.coalesce(covering, F.lit(0)), "_start": run_start(y, w)}

    marked = spread.windowed(base, by, length, 0, build=build, size=size).drop("_f")
    return spread.bucket_running(marked, by, {"seg_id": F.col("_start")}, size=size).drop("_start")


def pad_labels(labels: DataFrame, lengths: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """Labels forced to the series length: missing positions 0, surplus ones dropped."""
    spine = segment_points(
        lengths.select(*by, F.lit(0).cast("bigint").alias("start_t"), (F.col("n") - 1).alias("end_t")), lengths, by
    )
    return spine.join(labels.select(*by, "t", y), [*by, "t"], "left").withColumn(y, F.coalesce(F.col(y), F.lit(0)))


def align_end(flags: DataFrame, labels: DataFrame, by: Sequence[str], length: int, y: str = "y") -> DataFrame:
    """Window flags with the label of the window's last step."""
    truth = labels.select(*by, (F.col("t") - (length - 1)).alias("w"), y)
    return flags.join(truth, [*by, "w"])


def align_start(flags: DataFrame, labels: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """Every labelled step with the flag of the window that starts there, 0 past the last window."""
    starts = flags.select(*by, F.col("w").alias("t"), "pred")
    return labels.join(starts, [*by, "t"], "left").withColumn("pred", F.coalesce(F.col("pred"), F.lit(0)))


def align_any(cells: DataFrame, labels: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """A step is flagged when any of its node cells is; steps known to both sides are kept."""
    steps = cells.groupBy(*by, "t").agg(F.max("pred").alias("pred"))
    return steps.join(labels.select(*by, "t", y), [*by, "t"])


def average_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    name: str = "rank",
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """Ranks from 1 with ties averaged, per group."""
    by = list(by)
    if not spread.has_hot_group(df if bound_by is None else bound_by, by, limit):
        order, ties = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
        return df.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = spread.running_totals(counts, by, [F.col(value)], {"_upto": F.col("_n")}, limit)
    ranked = upto.withColumn(name, F.col("_upto") - (F.col("_n") - 1) / 2).drop("_n", "_upto")
    return spread.lookup_join(df, ranked, [*by, value])
