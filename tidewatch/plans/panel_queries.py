"""Registered queries: scalars, preparation, statistics, scaling, splits and windows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import losses
from tidewatch.operators import panel, prepare, select, spread, windows
from tidewatch.plans import tables
from tidewatch.plans.registry import query
from tidewatch.plans.tables import BY, KINDS, LENGTH, SHORT, WIDTH, sql, table

VECTOR = [f"v{i}" for i in range(WIDTH)]
HALVES = {0: VECTOR[: WIDTH // 2], 1: VECTOR[WIDTH // 2 :]}


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def long_vectors(df):
    return panel.to_long(df, ["series_id", "t"], VECTOR)


# ---- projections, predicates, scalars -------------------------------------------------


@query(
    "proj_feature_groups",
    sql(
        "vl",
        """SELECT series_id, t, CASE WHEN CAST(substr(feature, 2) AS INTEGER) < 32 THEN 0 ELSE 1 END AS grp,
        count(*) AS n_features, round(sum(x), 6) AS total FROM vl GROUP BY 1, 2, 3""",
    ),
)
def _(spark, folder):
    split = panel.group_columns(tables.vector_panel(spark, folder), ["series_id", "t"], HALVES)
    rows = split.select(
        "series_id",
        "t",
        F.inline(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"grp_{g}").alias("part")) for g in HALVES])),
    )
    return rows.select(
        "series_id",
        "t",
        "grp",
        F.size("part").cast("bigint").alias("n_features"),
        F.round(losses.total(F.col("part")), 6).alias("total"),
    )


@query(
    "clean_labels",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Attack' ELSE 'Normal' END AS label,
    CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders""",
)
def _(spark, folder):
    raw = F.when(F.col("o_orderstatus") == "F", " A ttack").otherwise("Normal ")
    orders = table(spark, folder, "orders").select("o_orderkey", raw.alias("raw"))
    return orders.select(
        "o_orderkey", prepare.clean_label(F.col("raw")).alias("label"), prepare.attack_flag(F.col("raw")).alias("y")
    )


@query(
    "coerce_numeric",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad' || event_id
    ELSE regexp_extract(props, '[0-9]+') END AS DOUBLE) AS number FROM events""",
)
def _(spark, folder):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("bad"), F.col("event_id"))).otherwise(
        F.regexp_extract("props", "[0-9]+", 0)
    )
    return table(spark, folder, "events").select("event_id", prepare.coerce_numeric(text).alias("number"))


@query(
    "assert_no_nan",
    sql(
        "d1",
        "SELECT series_id, feature, CAST(count(*) - count(x) AS BIGINT) AS n_missing FROM ("
        + " UNION ALL ".join(f"SELECT series_id, '{k}' AS feature, {k} AS x FROM d1" for k in KINDS)
        + ") GROUP BY 1, 2",
    ),
)
def _(spark, folder):
    prepare.assert_no_nan(tables.full_day_panel(spark, folder), KINDS)
    return prepare.missing_counts(tables.day_panel(spark, folder), BY, KINDS)


@query(
    "scalar_math",
    """SELECT event_id, round(abs(value - 20), 6) AS a_abs, round(exp(-value / 100), 6) AS a_exp,
    round(ln(value + 1e-12), 6) AS a_log, round(sqrt(value), 6) AS a_sqrt, round(value * value, 6) AS a_square,
    round((exp(value / 50) - exp(-value / 50)) / (exp(value / 50) + exp(-value / 50)), 6) AS a_tanh,
    round(sin(value), 6) AS a_sin, round(cos(value), 6) AS a_cos,
    greatest(5.0::DOUBLE, least(50.0::DOUBLE, value)) AS a_clip,
    CASE WHEN value > 20 THEN 1 ELSE 0 END AS a_where FROM events""",
)
def _(spark, folder):
    v = F.col("value")
    return table(spark, folder, "events").select(
        "event_id",
        F.round(F.abs(v - 20), 6).alias("a_abs"),
        F.round(F.exp(-v / 100), 6).alias("a_exp"),
        F.round(F.log(v + 1e-12), 6).alias("a_log"),
        F.round(F.sqrt(v), 6).alias("a_sqrt"),
        F.round(v * v, 6).alias("a_square"),
        F.round(F.tanh(v / 50), 6).alias("a_tanh"),
        F.round(F.sin(v), 6).alias("a_sin"),
        F.round(F.cos(v), 6).alias("a_cos"),
        F.greatest(F.lit(5.0), F.least(F.lit(50.0), v)).alias("a_clip"),
        F.when(v > 20, 1).otherwise(0).alias("a_where"),
    )


@query(
    "scalar_array",
    """SELECT vec_id, round(list_avg(CAST(embedding AS DOUBLE[])), 6) AS a_mean,
    round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS a_sum, round(CAST(list_max(embedding) AS DOUBLE), 6) AS a_max,
    round(list_sum(list_transform(list_reverse(e), lambda x, i: x * i)), 4) AS a_reverse,
    round(list_sum(list_transform(e[3:7], lambda x, i: x * i)), 4) AS a_slice, round(list_sum(list_transform(list_concat(e[63:64], e[1:62]), lambda x, i: x * i)), 4) AS a_roll,
    round(list_sum(list_transform(list_concat(e, e), lambda x, i: x * i)), 4) AS a_concat, round(list_sum(list_transform([e[1], e[1], e[1]], lambda x, i: x * i)), 4) AS a_repeat FROM (SELECT vec_id, embedding, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""",
)
def _(spark, folder):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rolled = F.concat(F.slice(v, -2, 2), F.slice(v, 1, WIDTH - 2))

    def whole(values):
        """Every value of an array in one number: each counts as often as its place."""
        return F.round(losses.total(F.transform(values, lambda x, i: x * (i + 1))), 4)

    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.round(losses.mean(v), 6).alias("a_mean"),
        F.round(losses.total(v), 6).alias("a_sum"),
        F.round(F.array_max(v), 6).alias("a_max"),
        whole(F.reverse(v)).alias("a_reverse"),
        whole(F.slice(v, 3, 5)).alias("a_slice"),
        whole(rolled).alias("a_roll"),
        whole(F.concat(v, v)).alias("a_concat"),
        whole(F.array_repeat(F.get(v, F.lit(0)), 3)).alias("a_repeat"),
    )


@query(
    "scalar_string",
    """SELECT p_partkey, trim('  ' || p_name || ' ') AS stripped, replace(p_type, ' ', '_') AS replaced,
    p_brand LIKE '%1' AS ends, regexp_replace('machine-' || p_partkey || '.txt', '\\.txt$', '') AS entity FROM part""",
)
def _(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("stripped"),
        F.replace(F.col("p_type"), F.lit(" "), F.lit("_")).alias("replaced"),
        F.col("p_brand").endswith("1").alias("ends"),
        F.regexp_replace(F.concat(F.lit("machine-"), "p_partkey", F.lit(".txt")), r"\.txt$", "").alias("entity"),
    )


@query(
    "scalar_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id + 3 AS seg_end,
    CAST(2 AS INTEGER) AS n_bounds FROM events""",
)
def _(spark, folder):
    text = F.concat(F.lit("[["), F.col("event_id"), F.lit(", "), F.col("event_id") + 3, F.lit("]]"))
    parsed = F.from_json(text, "array<array<bigint>>")
    return table(spark, folder, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        parsed[0][1].alias("seg_end"),
        F.size(parsed[0]).alias("n_bounds"),
    )


# ---- statistics -----------------------------------------------------------------------


@query(
    "agg_mean_std_pop",
    sql(
        "vl",
        "SELECT series_id, feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM vl GROUP BY 1, 2",
    ),
)
def _(spark, folder):
    wide = prepare.fit_moments(tables.vector_panel(spark, folder), BY, VECTOR)
    return rounded(prepare.stat_rows(wide, BY, VECTOR, ["mean", "std"]), ["mean", "std"])


@query(
    "agg_mean_std_sample",
    sql("nl", "SELECT metric, round(avg(x), 6) AS mean_x, round(stddev_samp(x), 6) AS std_x FROM nl GROUP BY 1"),
)
def _(spark, folder):
    stats = prepare.fit_moments(tables.node_panel(spark, folder), ["metric"], ["x"], sample=True)
    return rounded(stats, ["mean_x", "std_x"])


@query("agg_min_max", sql("vl", "SELECT series_id, feature, min(x) AS min, max(x) AS max FROM vl GROUP BY 1, 2"))
def _(spark, folder):
    wide = prepare.fit_range(tables.vector_panel(spark, folder), BY, VECTOR)
    return prepare.stat_rows(wide, BY, VECTOR, ["min", "max"])


@query(
    "agg_variance_filter",
    sql(
        "d3",
        "SELECT series_id, feature, round(var_samp(x), 6) AS var FROM ("
        + " UNION ALL ".join(f"SELECT series_id, '{k}' AS feature, {k} AS x FROM d3" for k in KINDS)
        + ") GROUP BY 1, 2 HAVING var_samp(x) >= 1e-6",
    ),
)
def _(spark, folder):
    return rounded(prepare.variance_filter(tables.full_day_panel(spark, folder), BY, KINDS), ["var"])


EVENT_FEATURES = ["x", "k", "y", "is_view"]
EVENT_LONG = "ev AS (" + " UNION ALL ".join(
    f"SELECT series_id, t, '{f}' AS feature, CAST({e} AS DOUBLE) AS x FROM e1"
    for f, e in (("x", "x"), ("k", "k"), ("y", "y"), ("is_view", "(event_type = 'view')::INT"))
) + ")"


def event_features(spark, folder):
    df = tables.event_panel(spark, folder)
    return df.select(
        "series_id",
        "t",
        "x",
        "k",
        F.col("y").cast("double").alias("y"),
        (F.col("event_type") == "view").cast("double").alias("is_view"),
    )


@query(
    "agg_two_valued",
    sql("e1", EVENT_LONG + " SELECT series_id, feature, count(DISTINCT x) <= 2 AS is_binary FROM ev GROUP BY 1, 2"),
)
def _(spark, folder):
    return prepare.two_valued(event_features(spark, folder), BY, EVENT_FEATURES)


@query(
    "agg_median_iqr",
    sql(
        "e1",
        EVENT_LONG + """ SELECT series_id, feature, round(quantile_cont(x, 0.5), 6) AS median,
        round(CASE WHEN quantile_cont(x, 0.75) = quantile_cont(x, 0.25) THEN 1
        ELSE quantile_cont(x, 0.75) - quantile_cont(x, 0.25) END, 6) AS iqr FROM ev GROUP BY 1, 2""",
    ),
)
def _(spark, folder):
    return rounded(prepare.median_iqr(event_features(spark, folder), BY, EVENT_FEATURES), ["median", "iqr"])


@query(
    "agg_percentile",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
    round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
def _(spark, folder):
    q = spread.percentiles(table(spark, folder, "events"), ["event_type"], "value", [0.5, 0.9, 0.95, 0.99])
    return q.select("event_type", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(["p50", "p90", "p95", "p99"])])


# ---- imputation, scaling, splits ------------------------------------------------------


@query(
    "win_interpolate",
    sql("d1 d2", "SELECT series_id, t, " + ", ".join(f"round({k}, 6) AS {k}" for k in KINDS) + " FROM d2"),
)
def _(spark, folder):
    return rounded(prepare.interpolate(tables.day_panel(spark, folder), BY, KINDS), KINDS)


@query(
    "scale_standard",
    sql(
        "vl",
        """st AS (SELECT series_id, feature, avg(x) AS m, stddev_pop(x) AS s FROM vl GROUP BY 1, 2)
        SELECT series_id, t, feature, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS x
        FROM vl JOIN st USING (series_id, feature)""",
    ),
)
def _(spark, folder):
    df = tables.vector_panel(spark, folder)
    scaled = prepare.scale_standard(df, prepare.fit_moments(df, BY, VECTOR), BY, VECTOR)
    return rounded(long_vectors(scaled), ["x"])


@query(
    "scale_standard_pooled",
    sql(
        "nl",
        """st AS (SELECT metric, avg(x) AS m, stddev_samp(x) AS s FROM nl GROUP BY 1)
        SELECT series_id, t, node, metric, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS x
        FROM nl JOIN st USING (metric)""",
    ),
)
def _(spark, folder):
    df = tables.node_panel(spark, folder)
    scaled = prepare.scale_standard(df, prepare.fit_moments(df, ["metric"], ["x"], sample=True), ["metric"], ["x"])
    return rounded(scaled, ["x"])


@query(
    "scale_minmax",
    sql(
        "vl",
        """st AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM vl GROUP BY 1)
        SELECT series_id, t, feature, round((x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS x
        FROM vl JOIN st USING (feature)""",
    ),
)
def _(spark, folder):
    df = tables.vector_panel(spark, folder)
    return rounded(long_vectors(prepare.scale_minmax(df, prepare.fit_range(df, [], VECTOR), [], VECTOR)), ["x"])


@query(
    "scale_binary",
    sql(
        "e1",
        """hf AS (SELECT series_id, t, 2.0::DOUBLE + 3 * y AS two, x FROM e1),
        st AS (SELECT series_id, min(two) AS lo, max(two) AS hi FROM hf JOIN (SELECT series_id, count(*) AS n FROM hf GROUP BY 1) USING (series_id)
        WHERE t < n - greatest(1, CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT)) GROUP BY 1)
        SELECT series_id, t, round(CASE WHEN hi > lo THEN (two - lo) / (hi - lo) ELSE two END, 6) AS two
        FROM hf JOIN st USING (series_id)""",
    ),
)
def _(spark, folder):
    df = tables.event_panel(spark, folder).select("series_id", "t", (F.lit(2.0) + 3 * F.col("y")).alias("two"))
    train = prepare.split_contiguous(df, BY, 0.3).where("split = 'train'")
    return rounded(prepare.scale_binary(df, prepare.fit_range(train, BY, ["two"]), BY, ["two"]), ["two"])


@query(
    "scale_robust",
    sql(
        "e1",
        """st AS (SELECT series_id, quantile_cont(x, 0.5) AS mx, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS ix,
        quantile_cont(k, 0.5) AS mk, quantile_cont(k, 0.75) - quantile_cont(k, 0.25) AS ik FROM e1 GROUP BY 1)
        SELECT series_id, t, round((x - mx) / CASE WHEN ix = 0 THEN 1 ELSE ix END, 6) AS x,
        round((k - mk) / CASE WHEN ik = 0 THEN 1 ELSE ik END, 6) AS k FROM e1 JOIN st USING (series_id)""",
    ),
)
def _(spark, folder):
    df = tables.event_panel(spark, folder).select("series_id", "t", "x", "k")
    return rounded(prepare.scale_robust(df, prepare.median_iqr(df, BY, ["x", "k"]), BY, ["x", "k"]), ["x", "k"])


BINARY_GROUPS = "(VALUES ('x', 0), ('k', 0), ('y', 1), ('is_view', 1)) g(feature, grp)"


@query(
    "detect_binary",
    sql(
        "e1",
        EVENT_LONG + f""", fl2 AS (SELECT series_id, feature, count(DISTINCT x) <= 2 AS b FROM ev GROUP BY 1, 2)
        SELECT series_id, grp, bool_and(b) AS is_binary FROM fl2 JOIN {BINARY_GROUPS} USING (feature) GROUP BY 1, 2""",
    ),
)
def _(spark, folder):
    flags = prepare.two_valued(event_features(spark, folder), BY, EVENT_FEATURES)
    groups = spark.createDataFrame([("x", 0), ("k", 0), ("y", 1), ("is_view", 1)], "feature string, grp int")
    return prepare.binary_groups(flags, groups, BY)


STATIC = {"click": "click", "zero": "0.0::DOUBLE", "one": "1.0::DOUBLE", "seven": "7.0::DOUBLE", "signup": "signup"}


@query(
    "sel_static",
    sql(
        "d3",
        "st AS ("
        + " UNION ALL ".join(f"SELECT series_id, '{f}' AS feature, {e} AS x FROM d3" for f, e in STATIC.items())
        + """) SELECT series_id, feature, CASE WHEN min(x) <> max(x) THEN 'kept' WHEN min(x) IN (0, 1) THEN 'sentinel'
        ELSE 'dropped' END AS verdict FROM st GROUP BY 1, 2""",
    ),
)
def _(spark, folder):
    df = tables.full_day_panel(spark, folder).withColumns(
        {"zero": F.lit(0.0), "one": F.lit(1.0), "seven": F.lit(7.0)}
    )
    return prepare.static_features(df, BY, list(STATIC))


@query(
    "win_split_contiguous",
    sql(
        "e1",
        """SELECT series_id, t, CASE WHEN t < n - greatest(1, CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT)) THEN 'train'
        ELSE 'val' END AS tail_split, CASE WHEN t < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS head_split
        FROM e1 JOIN (SELECT series_id, count(*) AS n FROM e1 GROUP BY 1) USING (series_id)""",
    ),
)
def _(spark, folder):
    df = tables.event_panel(spark, folder).select("series_id", "t")
    tail = prepare.split_contiguous(df, BY, 0.3).withColumnRenamed("split", "tail_split")
    return prepare.split_contiguous(tail, BY, 0.2, "head").withColumnRenamed("split", "head_split")


SPLIT_DRAW = "CAST('0x' || substr(md5(concat_ws(':', series_id, t, 42)), 1, 8) AS BIGINT)"


@query(
    "win_split_random",
    sql(
        "e1",
        f"""dr AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY {SPLIT_DRAW}, t) - 1 AS pos,
        count(*) OVER (PARTITION BY series_id) AS n FROM e1)
        SELECT series_id, t, CASE WHEN pos < ceil(round(n * CAST(0.15 AS DOUBLE), 9)) THEN 'test'
        WHEN pos < ceil(round(n * CAST(0.3 AS DOUBLE), 9)) THEN 'val' ELSE 'train' END AS split FROM dr""",
    ),
)
def _(spark, folder):
    df = tables.event_panel(spark, folder).select("series_id", "t")
    return prepare.split_random(df, BY, "t", {"test": 0.15, "val": 0.15})


# ---- windows --------------------------------------------------------------------------


@query(
    "win_sliding",
    sql(
        "e1",
        f"""SELECT series_id, t - {LENGTH - 1} AS w, t AS t_end, {LENGTH} AS n_rows,
        first_value(x) OVER fr AS first_x, last_value(k) OVER fr AS last_k, round(sum(x) OVER fr, 6) AS sum_x FROM e1
        WINDOW fr AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW)
        QUALIFY t >= {LENGTH - 1}""",
    ),
)
def _(spark, folder):
    wins = windows.sliding(tables.event_panel(spark, folder), BY, ["x", "k"], LENGTH)
    xs = F.transform("win", lambda r: r[0])
    return wins.select(
        "series_id",
        "w",
        "t_end",
        F.size("win").alias("n_rows"),
        F.col("win")[0][0].alias("first_x"),
        F.col("win")[LENGTH - 1][1].alias("last_k"),
        F.round(losses.total(xs), 6).alias("sum_x"),
    )


@query(
    "win_sliding_grouped",
    sql(
        "d3",
        f"""SELECT series_id, t - {SHORT - 1} AS w, t AS t_end, round(sum(click + error) OVER fr, 6) AS sum_0,
        round(sum(purchase + signup + view) OVER fr, 6) AS sum_1 FROM d3
        WINDOW fr AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {SHORT - 1} PRECEDING AND CURRENT ROW)
        QUALIFY t >= {SHORT - 1}""",
    ),
)
def _(spark, folder):
    groups = {0: ["click", "error"], 1: ["purchase", "signup", "view"]}
    df = windows.require_windows(tables.full_day_panel(spark, folder), BY, SHORT)
    wins = windows.sliding_grouped(df, BY, groups, SHORT)
    return wins.select(
        "series_id", "w", "t_end", *[F.round(losses.total(F.flatten(f"win_{g}")), 6).alias(f"sum_{g}") for g in groups]
    )


@query(
    "flatten_windows",
    sql(
        "d3",
        "lo AS ("
        + " UNION ALL ".join(f"SELECT series_id, t, {i} AS k, {k} AS x FROM d3" for i, k in enumerate(KINDS))
        + f""") SELECT lo.series_id, lo.t - j AS w, CAST(j * 5 + k AS INTEGER) AS place, x FROM lo, range({SHORT}) r(j)
        JOIN (SELECT series_id, max(t) AS top FROM d3 GROUP BY 1) m ON m.series_id = lo.series_id
        WHERE lo.t - j >= 0 AND lo.t - j + {SHORT - 1} <= m.top""",
    ),
)
def _(spark, folder):
    flat = windows.flatten_windows(windows.sliding(tables.full_day_panel(spark, folder), BY, KINDS, SHORT))
    return flat.select("series_id", "w", F.posexplode("vec").alias("place", "x"))


@query(
    "filter_windows",
    sql("e1 s1", "SELECT s.series_id, s.w, s.score FROM s1 s JOIN e1 ON e1.series_id = s.series_id AND e1.t = s.w AND e1.y = 0"),
)
def _(spark, folder):
    normal = tables.event_panel(spark, folder).where("y = 0").select("series_id", F.col("t").alias("w"))
    return windows.keep_windows(tables.window_scores(spark, folder), normal, BY).select("series_id", "w", "score")


@query(
    "win_diff",
    sql(
        "d3",
        "SELECT series_id, t, "
        + ", ".join(f"round({k} - lag({k}) OVER w, 6) AS {k}" for k in KINDS)
        + " FROM d3 WINDOW w AS (PARTITION BY series_id ORDER BY t) QUALIFY t > 0",
    ),
)
def _(spark, folder):
    return rounded(windows.diff(tables.full_day_panel(spark, folder), BY, KINDS), KINDS)


@query(
    "win_lag_align",
    sql(
        "d3",
        """SELECT a.series_id, b.t - a.t AS tau, a.t, a.click AS x, b.view AS y FROM d3 a
        JOIN (SELECT series_id, max(t) + 1 AS n FROM d3 GROUP BY 1) s ON s.series_id = a.series_id
        JOIN d3 b ON b.series_id = a.series_id AND b.t BETWEEN a.t - 4 AND a.t + 4 AND abs(b.t - a.t) <= n // 2""",
    ),
)
def _(spark, folder):
    return windows.lag_align(tables.full_day_panel(spark, folder), BY, "click", "view", 4)


@query(
    "win_avg_rank",
    sql(
        "e1",
        """SELECT series_id, t, k, rank() OVER (PARTITION BY series_id ORDER BY k)
        + (count(*) OVER (PARTITION BY series_id, k) - 1) / 2.0::DOUBLE AS rank FROM e1""",
    ),
)
def _(spark, folder):
    return windows.average_rank(tables.event_panel(spark, folder).select("series_id", "t", "k"), BY, "k")


@query(
    "win_segments",
    sql(
        "e1",
        """st AS (SELECT series_id, t, y, CAST(y = 1 AND coalesce(lag(y) OVER (PARTITION BY series_id ORDER BY t), 0) = 0 AS INT) AS s FROM e1),
        sg AS (SELECT *, sum(s) OVER (PARTITION BY series_id ORDER BY t) AS seg FROM st)
        SELECT series_id, CAST(seg AS BIGINT) AS seg_id, min(t) AS start_t, max(t) AS end_t FROM sg WHERE y = 1 GROUP BY 1, 2""",
    ),
)
def _(spark, folder):
    return windows.segments(tables.event_panel(spark, folder), BY)


@query(
    "join_self_pairs",
    sql(
        "d3",
        "lg AS ("
        + " UNION ALL ".join(f"SELECT series_id, t, '{k}' AS f, floor({k}) AS x FROM d3" for k in KINDS)
        + """) SELECT CAST(lag AS INTEGER) AS lag, a.series_id, a.f AS feature_i, b.f AS feature_j, count(*) AS n, sum(a.x * b.x) AS dot
        FROM lg a, range(4) r(lag) JOIN lg b ON b.series_id = a.series_id AND b.t = a.t + lag AND a.f < b.f GROUP BY ALL""",
    ),
)
def _(spark, folder):
    whole = tables.full_day_panel(spark, folder).withColumns({k: F.floor(k).cast("double") for k in KINDS})
    whole = spread.durable(whole)
    lags = [select.lagged_products(whole, BY, KINDS, tau).withColumn("lag", F.lit(tau)) for tau in range(4)]
    return functools.reduce(DataFrame.unionByName, lags).where("feature_i < feature_j")
