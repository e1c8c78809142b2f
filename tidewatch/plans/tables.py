"""Panels derived from the tables, and the same panels as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import panel, prepare, scoring, spread

BY = ["series_id"]
KINDS = ["click", "error", "purchase", "signup", "view"]
METRICS = ["qty", "price", "disc"]
WIDTH = 64
LENGTH = 30
SHORT = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One series per user, one step per event."""
    events = table(spark, folder, "events")
    rows = events.select(
        F.col("user_id").alias("series_id"),
        "ts",
        "event_id",
        "event_type",
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("event_type") == "error").cast("int").alias("y"),
    )
    return spread.row_index(rows, BY, ["ts", "event_id"], bound_by=events.select(F.col("user_id").alias("series_id")))


def day_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One series per user, one step per day, the summed value of each event type; days without are null."""
    events = table(spark, folder, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    cells = events.groupBy(F.col("user_id").alias("series_id"), day.alias("t")).agg(
        *[F.round(F.sum(F.when(F.col("event_type") == k, F.col("value"))), 2).alias(k) for k in KINDS]
    )
    return panel.regular_grid(cells, BY)


def full_day_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The day panel with its gaps filled; a type a user never had is 0."""
    filled = prepare.interpolate(day_panel(spark, folder), BY, KINDS)
    return filled.select("series_id", "t", *[F.round(F.coalesce(k, F.lit(0.0)), 6).alias(k) for k in KINDS])


def stored_day_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The filled day panel written once, for plans that read it several times."""
    return spread.durable(full_day_panel(spark, folder))


def vector_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One series per label, one step per vector, 64 features."""
    vectors = table(spark, folder, "embeddings")
    rows = vectors.select(F.col("label").alias("series_id"), "vec_id", "embedding")
    indexed = spread.row_index(rows, BY, ["vec_id"], bound_by=vectors.select(F.col("label").alias("series_id")))
    return panel.from_array(indexed, ["series_id", "t"], "embedding", WIDTH, "v")


def wide_node_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One series per supplier, one step per month, nodes = return flag and line status, a column per metric."""
    items = table(spark, folder, "lineitem")
    month = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    return items.groupBy(
        F.col("l_suppkey").alias("series_id"),
        month.cast("bigint").alias("t"),
        F.concat("l_returnflag", "l_linestatus").alias("node"),
    ).agg(
        F.sum("l_quantity").alias("qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.sum("l_discount"), 2).alias("disc"),
    )


def node_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The node panel with long metrics."""
    return panel.to_long(wide_node_panel(spark, folder), ["series_id", "t", "node"], METRICS, "metric", "x")


SQL = {
    "e1": """e1 AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
  ts, event_id, event_type, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  CAST(event_type = 'error' AS INTEGER) AS y FROM events)""",
    "d1": """d0 AS (SELECT user_id AS series_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS d,
  """ + ", ".join(f"round(sum(value) FILTER (event_type = '{k}'), 2) AS {k}" for k in KINDS) + """
  FROM events GROUP BY 1, 2),
db AS (SELECT series_id, min(d) AS lo, max(d) AS hi FROM d0 GROUP BY 1),
dg AS (SELECT series_id, lo, unnest(generate_series(lo, hi)) AS d FROM db),
d1 AS (SELECT dg.series_id, dg.d - dg.lo AS t, """ + ", ".join(KINDS) + """
  FROM dg LEFT JOIN d0 ON d0.series_id = dg.series_id AND d0.d = dg.d)""",
    "d2": "d2a AS (SELECT series_id, t"
    + "".join(
        f""",
  last_value({k} IGNORE NULLS) OVER up AS l_{k}, last_value(CASE WHEN {k} IS NOT NULL THEN t END IGNORE NULLS) OVER up AS lt_{k},
  last_value({k} IGNORE NULLS) OVER dn AS r_{k}, last_value(CASE WHEN {k} IS NOT NULL THEN t END IGNORE NULLS) OVER dn AS rt_{k}"""
        for k in KINDS
    )
    + """
  FROM d1 WINDOW up AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  dn AS (PARTITION BY series_id ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d2 AS (SELECT series_id, t"""
    + "".join(
        f""",
  CASE WHEN l_{k} IS NULL THEN r_{k} WHEN r_{k} IS NULL OR lt_{k} = rt_{k} THEN l_{k}
  ELSE l_{k} + (r_{k} - l_{k}) / (rt_{k} - lt_{k}) * (t - lt_{k}) END AS {k}"""
        for k in KINDS
    )
    + " FROM d2a)",
    "d3": "d3 AS (SELECT series_id, t, " + ", ".join(f"round(coalesce({k}, 0), 6) AS {k}" for k in KINDS) + " FROM d2)",
    "vl": """v0 AS (SELECT label AS series_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding FROM embeddings),
vl AS (SELECT series_id, t, 'v' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS x FROM v0, range(64) r(i))""",
    "nl": """n0 AS (SELECT l_suppkey AS series_id, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS BIGINT) AS t,
  l_returnflag || l_linestatus AS node, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price,
  round(sum(l_discount), 2) AS disc FROM lineitem GROUP BY 1, 2, 3),
nl AS (SELECT series_id, t, node, 'qty' AS metric, qty AS x FROM n0 UNION ALL SELECT series_id, t, node, 'price', price FROM n0
  UNION ALL SELECT series_id, t, node, 'disc', disc FROM n0)""",
}
NEEDS = {"d2": ["d1"], "d3": ["d1", "d2"]}


def sql(names: str, body: str) -> str:
    """``body`` behind the named panels; ``body`` may start with further CTEs and ends in a SELECT."""
    parts: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if SQL[n] not in parts:
                parts.append(SQL[n])
    body = body.strip()
    more = "" if body.upper().startswith("SELECT") else ",\n"
    return "WITH " + ",\n".join(parts) + (more or "\n") + body


# ---- scored windows of the event panel ------------------------------------------------


def window_scores(spark: SparkSession, folder: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Error of each 30-event window against its own mean."""
    scored = scoring.window_mean_error(event_panel(spark, folder), BY, ["x"], LENGTH, carry=carry)
    return scored.withColumn("score", F.round("score", 6))


def window_flags(spark: SparkSession, folder: str, carry: tuple[str, ...] = ()) -> DataFrame:
    scored = window_scores(spark, folder, carry)
    return scoring.flag(scored, scoring.fit_threshold(scored, BY, 95.0, bound_by=series_sizes(spark, folder)), BY)


def window_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged windows with the label of their last event, kept along while windowing."""
    return window_flags(spark, folder, ("y",))


def series_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event and series: bounds the size of everything cut from the event panel."""
    return table(spark, folder, "events").select(F.col("user_id").alias("series_id"))


def group_window_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Losses of two feature groups per window, marked train/val along time, written once."""
    errors = scoring.window_mean_group_errors(event_panel(spark, folder), BY, {0: ["x"], 1: ["k"]}, LENGTH)
    errors = errors.withColumn("loss", F.round("loss", 6))
    return spread.durable(prepare.split_contiguous(errors, BY, 0.3, t="w"))


SQL |= {
    "s1": """s1 AS (SELECT series_id, t - 29 AS w, t AS t_end, round(var_pop(x) OVER (PARTITION BY series_id ORDER BY t
  ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS score FROM e1 QUALIFY t >= 29)""",
    "fl": """th AS (SELECT series_id, quantile_cont(score, 0.95) AS threshold FROM s1 GROUP BY 1),
fl AS (SELECT s1.*, threshold, CAST(score > threshold AS INTEGER) AS pred FROM s1 JOIN th USING (series_id))""",
    "tr": "tr AS (SELECT fl.*, e1.y FROM fl JOIN e1 ON e1.series_id = fl.series_id AND e1.t = fl.t_end)",
    "gl": """g0 AS (SELECT series_id, t - 29 AS w, round(var_pop(x) OVER fr, 6) AS l0, round(var_pop(k) OVER fr, 6) AS l1 FROM e1
  WINDOW fr AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) QUALIFY t >= 29),
g1 AS (SELECT series_id, w, 0 AS grp, l0 AS loss FROM g0 UNION ALL SELECT series_id, w, 1, l1 FROM g0),
gl AS (SELECT series_id, w, grp, loss, CASE WHEN w < n - greatest(1, CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT))
  THEN 'train' ELSE 'val' END AS split FROM g1 JOIN (SELECT series_id, max(w) + 1 AS n FROM g1 GROUP BY 1) USING (series_id))""",
    "ec": """eq AS (SELECT series_id, grp, quantile_cont(loss, 0.005) AS lo, quantile_cont(loss, 0.995) AS hi FROM gl
  WHERE split = 'train' GROUP BY 1, 2),
ec AS (SELECT series_id, grp, loss, count(*) AS n FROM gl JOIN eq USING (series_id, grp)
  WHERE split = 'train' AND loss >= lo AND loss <= hi GROUP BY 1, 2, 3)""",
}
NEEDS |= {
    "s1": ["e1"],
    "fl": ["e1", "s1"],
    "tr": ["e1", "s1", "fl"],
    "gl": ["e1"],
    "ec": ["e1", "gl"],
}
