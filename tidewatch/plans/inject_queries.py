"""Registered queries: labelled faults placed into the event panel."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewatch.operators import inject
from tidewatch.plans import tables
from tidewatch.plans.registry import query
from tidewatch.plans.tables import BY, sql

FIRST = ["spike", "dropout", "sign_flip", "transplant"]
SECOND = ["ramp", "lag_shift", "time_warp", "event_roll"]
FEATURES = ["x", "k"]
SIZES = {"shortest": 8, "longest": 14, "gap": 3}


def bits(*keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 8) AS BIGINT)"


def place_sql(types: list[str]) -> str:
    k, low, high, gap = len(types), SIZES["shortest"], SIZES["longest"], SIZES["gap"]
    listed = ", ".join(f"('{t}')" for t in types)
    room = f"(n // {k} - {gap})"
    return f"""p0 AS (SELECT series_id, count(*) AS n FROM e1 GROUP BY 1),
p1 AS (SELECT series_id, n, type, row_number() OVER (PARTITION BY series_id ORDER BY {bits("0", "series_id", "'type'", "type")}, type) - 1 AS seg_id
  FROM p0, (VALUES {listed}) v(type)),
p2 AS (SELECT *, {low} + {bits("0", "series_id", "seg_id", "'len'")} % (least({high}, {room}) - {low} + 1) AS len FROM p1 WHERE {room} >= {low}),
pl AS (SELECT series_id, CAST(seg_id AS INTEGER) AS seg_id, type, n, seg_id * (n // {k}) + {bits("0", "series_id", "seg_id", "'offset'")} % ({room} - len + 1) AS start,
  len, 3 + {bits("0", "series_id", "seg_id", "'ramp'")} % 3 AS ramp FROM p2)"""


IN = """ip AS (SELECT e1.series_id, e1.t, e1.x, e1.k, pl.seg_id, pl.n, pl.start, pl.len, e1.t - pl.start AS i,
  greatest(1, least(ramp, (len - 1) // 2)) AS r, least(e1.t - pl.start, len - 1 - (e1.t - pl.start)) AS edge
  FROM e1 JOIN pl ON pl.series_id = e1.series_id AND pl.type = '{kind}' AND e1.t BETWEEN pl.start AND pl.start + pl.len - 1),
iw AS (SELECT *, CASE WHEN edge >= r THEN 1.0::DOUBLE WHEN r = 1 THEN 0 ELSE 0.5 * (1 - cos(pi() * edge / (r - 1))) END AS w FROM ip)"""


def fault_sql(kind: str, value: str, extra: str = "", types: list[str] | None = None) -> str:
    """``value`` is the faulty value of feature {f}; ``extra`` may define iz from iw, else iz is iw."""
    types = types or (FIRST if kind in FIRST else SECOND)
    body = ", ".join(
        f"round(CASE WHEN z.w IS NULL THEN e1.{f} ELSE e1.{f} * (1 - z.w) + z.a_{f} * z.w END, 6) AS {f}" for f in FEATURES
    )
    values = ", ".join(f"{value.replace('{f}', f)} AS a_{f}" for f in FEATURES)
    return sql(
        "e1",
        place_sql(types)
        + ",\n"
        + IN.format(kind=kind)
        + ",\n"
        + (extra or "iz AS (SELECT * FROM iw)")
        + f""",
        za AS (SELECT series_id, t, w, {values} FROM iz)
        SELECT e1.series_id, e1.t, {body} FROM e1 LEFT JOIN za z ON z.series_id = e1.series_id AND z.t = e1.t""",
    )


def gathered(at: str, name: str = "_m_") -> str:
    """iz = iw with the values found at another step."""
    return f"""ia AS (SELECT *, {at} AS at FROM iw),
    iz AS (SELECT ia.*, m.x AS m_x, m.k AS m_k FROM ia LEFT JOIN e1 m ON m.series_id = ia.series_id AND m.t = ia.at)"""


def setup(spark, folder, types):
    df = tables.event_panel(spark, folder).select("series_id", "t", *FEATURES)
    lengths = tables.series_sizes(spark, folder).groupBy("series_id").agg(F.count("*").alias("n"))
    return df, lengths, inject.place(lengths, BY, types, **SIZES)


def rounded(df):
    return df.withColumns({f: F.round(f, 6) for f in FEATURES})


@query("inject_place", sql("e1", place_sql(FIRST) + " SELECT series_id, seg_id, type, start, len, ramp FROM pl"))
def _(spark, folder):
    return setup(spark, folder, FIRST)[2]


@query("inject_ramp", fault_sql("ramp", "100.0::DOUBLE"))
def _(spark, folder):
    df, _, segs = setup(spark, folder, SECOND)
    return rounded(inject.ramp_to(df, segs, BY, FEATURES, F.lit(100.0)))


def normal_sql(f: str) -> str:
    u, v = (f"(({bits('0', 'series_id', 't', repr(f), repr(s))} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)" for s in "uv")
    return f"sqrt(-2 * ln({u})) * cos({2 * math.pi!r}::DOUBLE * {v})"


SPIKE = "{f} + 4 * 0.05::DOUBLE * noise_{f} * exp(-(i - len / 2) * (i - len / 2) / (2 * greatest(3, len / 6) * greatest(3, len / 6)))"


@query(
    "inject_spike",
    fault_sql(
        "spike", SPIKE, f"iz AS (SELECT *, {normal_sql('x')} AS noise_x, {normal_sql('k')} AS noise_k FROM iw)"
    ),
)
def _(spark, folder):
    df, _, segs = setup(spark, folder, FIRST)
    return rounded(inject.spike(df, segs, BY, FEATURES))


@query("inject_dropout", fault_sql("dropout", "coalesce(m_{f}, 0)", gathered("start - 1")))
def _(spark, folder):
    df, _, segs = setup(spark, folder, FIRST)
    return rounded(inject.dropout(df, segs, BY, FEATURES))


@query("inject_sign_flip", fault_sql("sign_flip", "-{f}"))
def _(spark, folder):
    df, _, segs = setup(spark, folder, FIRST)
    return rounded(inject.sign_flip(df, segs, BY, FEATURES))


SOURCE = f"""ib AS (SELECT *, {bits("0", "series_id", "seg_id", "'src'")} % (n - len + 1) AS src FROM iw),
ic AS (SELECT *, CASE WHEN abs(src - start) < len THEN (src + 4 * len) % greatest(n - len, 1) ELSE src END AS src2 FROM ib),
iz AS (SELECT ic.*, m.x AS m_x, m.k AS m_k FROM ic LEFT JOIN e1 m ON m.series_id = ic.series_id AND m.t = ic.src2 + ic.i)"""


@query("inject_transplant", fault_sql("transplant", "coalesce(m_{f}, {f})", SOURCE))
def _(spark, folder):
    df, lengths, segs = setup(spark, folder, FIRST)
    return rounded(inject.transplant(df, segs, lengths, BY, FEATURES))


@query("inject_lag_shift", fault_sql("lag_shift", "coalesce(m_{f}, {f})", gathered("greatest(0, t - 4)")))
def _(spark, folder):
    df, _, segs = setup(spark, folder, SECOND)
    return rounded(inject.lag_shift(df, segs, BY, FEATURES))


SHIFT = f"([-10, -8, -6, 6, 8, 10])[1 + {bits('0', 'series_id', 'seg_id', repr('roll'))} % 6]"


@query(
    "inject_event_roll",
    fault_sql("event_roll", "coalesce(m_{f}, {f})", gathered(f"start + (((i - {SHIFT}) % len) + len) % len")),
)
def _(spark, folder):
    df, _, segs = setup(spark, folder, SECOND)
    return rounded(inject.event_roll(df, segs, BY, FEATURES))


WARP = f"""ib AS (SELECT *, CASE WHEN {bits('0', 'series_id', 'seg_id', repr('warp'))} % 2 = 0 THEN 0.7 ELSE 1.3 END::DOUBLE AS f, len - 1 AS top FROM iw),
ic AS (SELECT *, floor(top / f) AS whole FROM ib),
id AS (SELECT *, CASE WHEN i = top THEN top WHEN f < 1 THEN least(i / f, top) WHEN i < whole * f THEN least(i / f, top)
  ELSE least(whole + (i - whole * f) / greatest(top - whole * f, 1e-12), top) END AS pos FROM ic),
iz AS (SELECT id.*, a.x AS a1_x, a.k AS a1_k, b.x AS b1_x, b.k AS b1_k FROM id
  LEFT JOIN e1 a ON a.series_id = id.series_id AND a.t = id.start + floor(pos)
  LEFT JOIN e1 b ON b.series_id = id.series_id AND b.t = id.start + ceil(pos))"""


@query("inject_time_warp", fault_sql("time_warp", "a1_{f} + (b1_{f} - a1_{f}) * (pos - floor(pos))", WARP))
def _(spark, folder):
    df, _, segs = setup(spark, folder, SECOND)
    return rounded(inject.time_warp(df, segs, BY, FEATURES))


@query(
    "inject_type_labels",
    sql(
        "e1",
        place_sql(FIRST)
        + " SELECT e1.series_id, e1.t, CAST(pl.type IS NOT NULL AS INTEGER) AS y, "
        + ", ".join(f"CAST(coalesce(pl.type = '{t}', false) AS INTEGER) AS y_{t}" for t in FIRST)
        + " FROM e1 LEFT JOIN pl ON pl.series_id = e1.series_id AND e1.t BETWEEN pl.start AND pl.start + pl.len - 1",
    ),
)
def _(spark, folder):
    df, _, segs = setup(spark, folder, FIRST)
    return inject.type_labels(df, segs, BY, FIRST)
