"""Labelled faults in an existing panel.

``segments`` has (by..., seg_id, type, start, len, ramp). A fault is a table of replacement
values for the rows of its segments, blended in with cosine ramps at both ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import draws
from tidewatch.operators import spread

# Fixed values of the faults: delay in steps, warp factors, roll shifts, noise level.
LAG_STEPS = 4
WARP_FACTORS = (0.7, 1.3)
ROLL_SHIFTS = (-10, -8, -6, 6, 8, 10)
NOISE_STD = 0.05


def place(
    lengths: DataFrame,
    by: Sequence[str],
    types: Sequence[str],
    seed: int = 0,
    shortest: int = 45,
    longest: int = 90,
    gap: int = 6,
) -> DataFrame:
    """One segment per type and series in equal slots: never overlapping, ``gap`` apart.

    Length, offset and ramp are drawn from the seed, the series and the slot. Which type goes
    to which slot is drawn per series. Slots too short for the shortest segment stay empty.
    """
    k = len(types)
    slot = F.floor(F.col("n") / k)
    draw_key = [F.lit(seed), *[F.col(c) for c in by]]
    order = F.array_sort(
        F.array(
            *[
                F.struct(draws.hash_bits(*draw_key, F.lit("type"), F.lit(t)).alias("h"), F.lit(t).alias("type"))
                for t in types
            ]
        )
    )
    slots = lengths.select(*by, "n", F.posexplode(order).alias("seg_id", "_t"))
    keys = [*draw_key, F.col("seg_id")]
    room = slot - gap
    slots = slots.where(room >= shortest).withColumn(
        "len", draws.integer(F.lit(shortest), F.least(F.lit(longest), room), *keys, F.lit("len"))
    )
    offset = draws.integer(F.lit(0), room - F.col("len"), *keys, F.lit("offset"))
    return slots.select(
        *by,
        "seg_id",
        F.col("_t.type").alias("type"),
        (F.col("seg_id") * slot + offset).cast("bigint").alias("start"),
        "len",
        draws.integer(3, 5, *keys, F.lit("ramp")).alias("ramp"),
    )


def unplaced(lengths: DataFrame, by: Sequence[str], types: Sequence[str], shortest: int = 45, gap: int = 6) -> DataFrame:
    """(by, n_unplaced): segments that ``place`` leaves out because a series is too short for them."""
    short = F.floor(F.col("n") / len(types)) - gap < shortest
    return lengths.select(*by, F.when(short, len(types)).otherwise(0).alias("n_unplaced"))


def ramp_weight(i: Column, length: Column, ramp: Column) -> Column:
    """Weight of the fault at position i of its segment: a cosine rise and fall over ``ramp`` steps."""
    r = F.greatest(F.lit(1), F.least(ramp, F.floor((length - 1) / 2)))
    edge = F.least(i, length - 1 - i)
    rise = F.when(r == 1, F.lit(0.0)).otherwise(
        F.lit(0.5) * (1 - F.cos(F.lit(math.pi) * edge / F.greatest(r - 1, F.lit(1))))
    )
    return F.when(edge >= r, F.lit(1.0)).otherwise(rise)


def inside(df: DataFrame, segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """The panel rows within segments, with i = position in the segment. Ends at the series end."""
    points = segments.withColumn(
        "t", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))
    ).withColumn("i", F.col("t") - F.col("start"))
    return df.join(points, [*by, "t"])


def _gather(rows: DataFrame, df: DataFrame, by, at: str, features, prefix: str) -> DataFrame:
    """Add the features found at step ``at`` as <prefix><feature> (null when there is none)."""
    source = df.select(*by, F.col("t").alias(at), *[F.col(f).alias(prefix + f) for f in features])
    return rows.join(source, [*by, at], "left")


def blend(df: DataFrame, faults: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """df with x(1 - w) + a·w on the rows of ``faults`` (by, t, w, a_<feature>...)."""
    out = df.join(faults.select(*by, "t", "w", *[f"a_{f}" for f in features]), [*by, "t"], "left")
    mixed = {
        f: F.when(F.col("w").isNull(), F.col(f)).otherwise(F.col(f) * (1 - F.col("w")) + F.col(f"a_{f}") * F.col("w"))
        for f in features
    }
    return out.select(*[mixed[c].alias(c) if c in mixed else F.col(c) for c in df.columns])


def _weighted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("w", ramp_weight(F.col("i"), F.col("len"), F.col("ramp")))


def _only(segments: DataFrame, kind: str) -> DataFrame:
    return segments.where(F.col("type") == kind)


def ramp_to(df: DataFrame, segments: DataFrame, by, features, level: Column, kind: str = "ramp") -> DataFrame:
    """Blend the segments towards a given level."""
    rows = _weighted(inside(df, _only(segments, kind), by))
    return blend(df, rows.withColumns({f"a_{f}": level for f in features}), by, features)


def spike(
    df: DataFrame, segments: DataFrame, by, features, noise_std: float = NOISE_STD, seed: int = 0, kind: str = "spike"
) -> DataFrame:
    """Add noise under a Gaussian envelope centred in the segment."""
    rows = _weighted(inside(df, _only(segments, kind), by))
    centre = F.col("len") / 2
    width = F.greatest(F.lit(3.0), F.col("len") / 6)
    envelope = F.exp(-(F.col("i") - centre) * (F.col("i") - centre) / (2 * width * width))

    def noise(f: str) -> Column:
        keys = [F.lit(seed), *[F.col(c) for c in by], F.col("t"), F.lit(f)]
        return F.lit(4 * noise_std) * draws.normal(*keys)

    return blend(df, rows.withColumns({f"a_{f}": F.col(f) + noise(f) * envelope for f in features}), by, features)


def dropout(df: DataFrame, segments: DataFrame, by, features, kind: str = "dropout") -> DataFrame:
    """Hold the value before the segment; 0 for a segment at the very start."""
    rows = _weighted(inside(df, _only(segments, kind), by)).withColumn("_at", F.col("start") - 1)
    held = _gather(rows, df, by, "_at", features, "_h_")
    return blend(df, held.withColumns({f"a_{f}": F.coalesce(f"_h_{f}", F.lit(0.0)) for f in features}), by, features)


def sign_flip(df: DataFrame, segments: DataFrame, by, features, kind: str = "sign_flip") -> DataFrame:
    rows = _weighted(inside(df, _only(segments, kind), by))
    return blend(df, rows.withColumns({f"a_{f}": -F.col(f) for f in features}), by, features)


def _replace_from(df, rows, by, features) -> DataFrame:
    moved = _gather(_weighted(rows), df, by, "_at", features, "_m_")
    return blend(df, moved.withColumns({f"a_{f}": F.coalesce(f"_m_{f}", f) for f in features}), by, features)


def transplant(
    df: DataFrame, segments: DataFrame, lengths: DataFrame, by, features, seed: int = 0, kind: str = "transplant"
) -> DataFrame:
    """Copy another stretch of the same series; a stretch that is too near is moved on by 4 lengths."""
    chosen = spread.lookup_join(_only(segments, kind), lengths, by)
    last = F.col("n") - F.col("len")
    drawn = draws.integer(F.lit(0), last, F.lit(seed), *[F.col(c) for c in by], F.col("seg_id"), F.lit("src"))
    chosen = chosen.withColumn("_src", drawn)
    near = F.abs(F.col("_src") - F.col("start")) < F.col("len")
    moved = F.pmod(F.col("_src") + 4 * F.col("len"), F.greatest(last, F.lit(1)))
    chosen = chosen.withColumn("_src", F.when(near, moved).otherwise(F.col("_src"))).drop("n")
    rows = inside(df, chosen, by).withColumn("_at", F.col("_src") + F.col("i"))
    return _replace_from(df, rows, by, features)


def lag_shift(df: DataFrame, segments: DataFrame, by, features, lag: int = LAG_STEPS, kind: str = "lag_shift") -> DataFrame:
    """Delay the observed rows by ``lag`` steps."""
    rows = inside(df, _only(segments, kind), by)
    rows = rows.withColumn("_at", F.greatest(F.lit(0).cast("bigint"), F.col("t") - lag))
    return _replace_from(df, rows, by, features)


def event_roll(df: DataFrame, segments: DataFrame, by, features, seed: int = 0, kind: str = "event_roll") -> DataFrame:
    """Shift the rows of the segment around in a circle."""
    shifts = F.array(*[F.lit(s) for s in ROLL_SHIFTS])
    pick = draws.integer(0, len(ROLL_SHIFTS) - 1, F.lit(seed), *[F.col(c) for c in by], F.col("seg_id"), F.lit("roll"))
    rolled = _only(segments, kind).withColumn("_shift", F.get(shifts, pick.cast("int")))
    rows = inside(df, rolled, by)
    rows = rows.withColumn("_at", F.col("start") + F.pmod(F.col("i") - F.col("_shift"), F.col("len")))
    return _replace_from(df, rows, by, features)


def warp_position(i: Column, length: Column, factor: Column) -> Column:
    """Where in the segment the warped row i is read: the inverse of clip(k * factor, 0, len - 1)."""
    top = length - 1
    whole = F.floor(top / factor)
    tail = whole + (i - whole * factor) / F.greatest(top - whole * factor, F.lit(1e-12))
    stretched = F.when(i < whole * factor, i / factor).otherwise(tail)
    return F.when(i == top, top.cast("double")).when(factor < 1, F.least(i / factor, top)).otherwise(
        F.least(stretched, top)
    )


def time_warp(df: DataFrame, segments: DataFrame, by, features, seed: int = 0, kind: str = "time_warp") -> DataFrame:
    """Replay the segment slower or faster, by linear interpolation between its rows."""
    factors = F.array(*[F.lit(f) for f in WARP_FACTORS])
    pick = draws.integer(0, len(WARP_FACTORS) - 1, F.lit(seed), *[F.col(c) for c in by], F.col("seg_id"), F.lit("warp"))
    warped = _only(segments, kind).withColumn("_factor", F.get(factors, pick.cast("int")))
    rows = _weighted(inside(df, warped, by)).withColumn(
        "_pos", warp_position(F.col("i"), F.col("len"), F.col("_factor"))
    )
    rows = rows.withColumns(
        {"_lo": F.col("start") + F.floor("_pos"), "_hi": F.col("start") + F.ceil("_pos"), "_part": F.col("_pos") - F.floor("_pos")}
    )
    near = _gather(_gather(rows, df, by, "_lo", features, "_a_"), df, by, "_hi", features, "_b_")
    value = {
        f"a_{f}": F.coalesce(F.col(f"_a_{f}") + (F.col(f"_b_{f}") - F.col(f"_a_{f}")) * F.col("_part"), F.col(f))
        for f in features
    }
    return blend(df, near.withColumns(value), by, features)


def type_labels(df: DataFrame, segments: DataFrame, by: Sequence[str], types: Sequence[str]) -> DataFrame:
    """(by, t, y, y_<type>...): 1 inside a segment, and inside a segment of that type."""
    points = segments.select(
        *by, "type", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("t")
    )
    marks = points.groupBy(*by, "t").agg(
        F.lit(1).alias("y"), *[F.max((F.col("type") == k).cast("int")).alias(f"y_{k}") for k in types]
    )
    out = df.select(*by, "t").join(marks, [*by, "t"], "left")
    return out.select(*by, "t", *[F.coalesce(c, F.lit(0)).alias(c) for c in ["y", *[f"y_{k}" for k in types]]])
