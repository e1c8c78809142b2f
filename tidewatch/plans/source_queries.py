"""Registered queries: readers on files written from the tables, and streams over the events."""

from __future__ import annotations

import io
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewatch.operators import panel as shapes
from tidewatch.operators import scoring, spread, windows
from tidewatch.plans import tables
from tidewatch.plans.registry import query
from tidewatch.plans.tables import BY, LENGTH, WIDTH, sql, table
from tidewatch.sources import readers, sinks
from tidewatch.streaming import online

VECTOR = [f"v{i}" for i in range(WIDTH)]


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- matrices -------------------------------------------------------------------------


def matrix_files(spark, folder):
    """One folder of headerless number files per label, in step order."""
    path = sinks.scratch(spark, "matrix")
    df = tables.vector_panel(spark, folder)
    lines = df.select(
        F.concat(F.lit("machine-"), "series_id").alias("machine"), "t", F.concat_ws(",", *VECTOR).alias("value")
    )
    ordered = lines.repartitionByRange("machine", "t").sortWithinPartitions("machine", "t")
    ordered.select("machine", "value").write.partitionBy("machine").text(path)
    return path


@query("src_matrix", sql("vl", "SELECT 'machine-' || series_id AS series_id, t, feature, round(x, 6) AS x FROM vl"))
def _(spark, folder):
    df = readers.matrix(spark, matrix_files(spark, folder), folders=True, features=VECTOR)
    return rounded(shapes.to_long(df, ["series_id", "t"], VECTOR), ["x"])


@query("src_entities", "SELECT DISTINCT 'machine-' || label AS series_id FROM embeddings ORDER BY 1")
def _(spark, folder):
    return readers.entities(spark, matrix_files(spark, folder), ".txt", folders=True)


@query(
    "src_npy",
    """SELECT CAST(vec_id // 64 AS VARCHAR) AS series_id, dense_rank() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS t,
    CAST(i AS INTEGER) AS place, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS x FROM embeddings, range(64) r(i)
    """,
)
def _(spark, folder):
    path = sinks.scratch(spark, "arrays")

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        np.save(held, np.stack(pdf.sort_values("vec_id")["embedding"].to_numpy()))
        return pd.DataFrame({"path": [f"{key[0]}.npy"], "content": [held.getvalue()]})

    blocks = table(spark, folder, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 64).alias("b"))
    blocks.groupBy("b").applyInPandas(pack, "path string, content binary").write.parquet(path)
    rows = readers.npy_rows(spark.read.parquet(path))
    return rows.select("series_id", "t", F.posexplode("values").alias("place", "x")).withColumn("x", F.round("x", 6))


# ---- labels ---------------------------------------------------------------------------

CHANNEL_SQL = """st AS (SELECT series_id, t, y, CAST(y = 1 AND coalesce(lag(y) OVER (PARTITION BY series_id ORDER BY t), 0) = 0 AS INT) AS s FROM e1),
sn AS (SELECT series_id, t, y, sum(s) OVER (PARTITION BY series_id ORDER BY t) AS seg FROM st),
sg AS (SELECT series_id, seg, min(t) AS a, max(t) AS b FROM sn WHERE y = 1 GROUP BY 1, 2),
ch AS (SELECT 'C-' || sg.series_id AS chan_id, CASE WHEN sg.series_id % 2 = 0 THEN 'SMAP' ELSE 'MSL' END AS spacecraft,
  CAST(row_number() OVER (PARTITION BY sg.series_id ORDER BY a) - 1 AS INTEGER) AS seg_id, a AS start_t, b AS end_t, n.n AS n
  FROM sg JOIN (SELECT series_id, CAST(count(*) AS INTEGER) AS n FROM e1 GROUP BY 1) n USING (series_id))"""


def channel_file(spark, folder):
    """A labelled-interval table with one row per user that has errors, sorted by channel name."""
    path = sinks.scratch(spark, "labels")
    df = tables.event_panel(spark, folder).select("series_id", "t", "y")
    spans = windows.segments(df, BY)
    n = df.groupBy("series_id").agg(F.count("*").alias("num_values"))
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("start_t", "end_t"))),
        lambda s: F.concat(F.lit("["), s["start_t"].cast("string"), F.lit(", "), s["end_t"].cast("string"), F.lit("]")),
    )
    rows = spans.groupBy("series_id").agg(F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]")).alias("anomaly_sequences"))
    rows = rows.join(n, "series_id").select(
        F.concat(F.lit("C-"), "series_id").alias("chan_id"),
        F.when(F.col("series_id") % 2 == 0, "SMAP").otherwise("MSL").alias("spacecraft"),
        "anomaly_sequences",
        F.lit("point").alias("class"),
        "num_values",
    )
    rows.repartitionByRange("chan_id").sortWithinPartitions("chan_id").write.csv(path, header=True)
    return readers.channel_table(spark, path)


@query("src_channels", sql("e1", CHANNEL_SQL + " SELECT DISTINCT chan_id FROM ch WHERE spacecraft = 'SMAP' ORDER BY 1"))
def _(spark, folder):
    return readers.channels(channel_file(spark, folder), "SMAP")


@query("filter_channel_label", sql("e1", CHANNEL_SQL + " SELECT DISTINCT chan_id, spacecraft, n AS num_values FROM ch WHERE spacecraft = 'MSL'"))
def _(spark, folder):
    return readers.channel_rows(channel_file(spark, folder), "MSL").select("chan_id", "spacecraft", "num_values")


@query("src_intervals", sql("e1", CHANNEL_SQL + " SELECT chan_id AS series_id, seg_id, start_t, end_t, n FROM ch"))
def _(spark, folder):
    return readers.intervals(channel_file(spark, folder))


@query(
    "src_dim_intervals",
    """SELECT 'machine-' || p_size AS series_id, p_partkey * 3 AS start_t, p_partkey * 3 + p_size AS end_t, d AS dim
    FROM part, LATERAL (SELECT unnest([p_size, p_size + 2, 7]) AS d)""",
)
def _(spark, folder):
    path = sinks.scratch(spark, "dims")
    size = F.col("p_size")
    line = F.concat(
        (F.col("p_partkey") * 3).cast("string"),
        F.lit("-"),
        (F.col("p_partkey") * 3 + size).cast("string"),
        F.lit(":"),
        F.concat_ws(",", size, size + 2, F.lit(7)),
    )
    rows = table(spark, folder, "part").select(F.concat(F.lit("machine-"), size).alias("machine"), line.alias("value"))
    rows.repartition("machine").write.partitionBy("machine").text(path)
    spans = readers.interpretation_labels(spark, path, folders=True)
    return spans.select("series_id", "start_t", "end_t", F.explode("dims").alias("dim"))


# ---- plant and cluster tables ---------------------------------------------------------

PLANT_SQL = """SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS t, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
o_totalprice AS "FIT101", CAST({second} AS DOUBLE) AS "LIT101" FROM orders"""


def plant_files(spark, folder, broken: bool):
    """Orders as a plant log: padded header, split label spelling, some unreadable values."""
    path = sinks.scratch(spark, "plant")
    label = F.when(F.col("o_orderstatus") == "F", "A ttack").otherwise("Normal")
    second = F.col("o_custkey").cast("string")
    if broken:
        second = F.when(F.col("o_orderkey") % 7 == 3, F.lit("Bad Input")).otherwise(second)
    orders = table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy hh:mm:ss a").alias(" Timestamp"),
        F.col("o_totalprice").alias(" FIT101"),
        second.alias("LIT101 "),
        label.alias("Normal/Attack"),
        F.col("o_orderdate").alias("_d"),
        F.col("o_orderkey").alias("_k"),
    )
    ordered = orders.repartitionByRange("_d", "_k").sortWithinPartitions("_d", "_k").drop("_d", "_k")
    ordered.write.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path, header=True)
    return path


@query("src_plant_csv", PLANT_SQL.format(second="o_custkey"))
def _(spark, folder):
    return readers.plant_csv(spark, plant_files(spark, folder, broken=False))


@query(
    "src_plant_csv_lenient",
    """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS t, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice,
      CASE WHEN o_orderkey % 7 <> 3 THEN CAST(o_custkey AS DOUBLE) END AS x FROM orders),
    e AS (SELECT *, last_value(x IGNORE NULLS) OVER up AS l, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER up AS lt,
      last_value(x IGNORE NULLS) OVER dn AS r, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER dn AS rt FROM o
      WINDOW up AS (ORDER BY t ROWS UNBOUNDED PRECEDING), dn AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))
    SELECT t, y, o_totalprice AS "FIT101", round(CASE WHEN l IS NULL THEN r WHEN r IS NULL OR lt = rt THEN l
      ELSE l + (r - l) / (rt - lt) * (t - lt) END, 6) AS "LIT101" FROM e""",
)
def _(spark, folder):
    df = readers.plant_csv(spark, plant_files(spark, folder, broken=True), on_bad="impute")
    return rounded(df, ["LIT101"])


@query(
    "src_multiheader",
    """WITH c AS (SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS t, c_acctbal, c_nationkey FROM customer)
    SELECT 'all' AS series_id, row_number() OVER (ORDER BY t) - 1 AS t, 'host1' AS node, 'cpu' AS metric, c_acctbal AS x FROM c
    UNION ALL SELECT 'all', row_number() OVER (ORDER BY t) - 1, 'host2', 'cpu', CAST(c_nationkey AS DOUBLE) FROM c""",
)
def _(spark, folder):
    path = sinks.scratch(spark, "cluster")
    heads = spark.range(2).select(
        (F.col("id") - 2).alias("k"),
        F.when(F.col("id") == 0, "date,host1,host2,label").otherwise("date,cpu,cpu,label").alias("value"),
    )
    line = F.concat_ws(",", F.lit("2024-01-01"), "c_acctbal", "c_nationkey", F.lit(0))
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), line.alias("value"))
    heads.unionByName(rows).repartitionByRange("k").sortWithinPartitions("k").select("value").write.text(path)
    return readers.multiheader(spark, path)


# ---- streams --------------------------------------------------------------------------


def feed(spark, folder, build, delay=None):
    """The events arrive in three slices of time; ``build(stream)`` is run after each arrival.

    With ``delay``, a column of minutes, events arrive that much later than they happened.
    """
    inbox, out = sinks.scratch(spark, "inbox"), sinks.scratch(spark, "stream")
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * i / 3 for i in (1, 2)]
    came = F.col("ts") if delay is None else F.col("ts") + F.make_dt_interval(mins=delay)
    slices = [came < cuts[0], (came >= cuts[0]) & (came < cuts[1]), came >= cuts[1]]
    for inside in slices:
        events.where(inside).write.mode("append").parquet(inbox)
        stream = build(online.read_events(spark, inbox))
        online.advance(stream, out)
    return online.results(stream, out)


@query(
    "stream_panel",
    """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end",
    count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM events
    WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    out = feed(spark, folder, lambda s: online.panel(s, ["event_type"], "value", "1 hour", late="1 hour"))
    return naive(rounded(out, ["total"], 4))


def naive(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "stream_segments",
    """WITH f AS (SELECT user_id, ts FROM events WHERE value > 30),
    g AS (SELECT *, CAST(coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true) AS INT) AS s FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS seg FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n_flags FROM h GROUP BY user_id, seg
    HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM f)""",
)
def _(spark, folder):
    return naive(feed(spark, folder, lambda s: online.alarms(s.where("value > 30"), ["user_id"], "12 hours")))


@query(
    "stream_score",
    sql(
        "e1 s1 fl",
        """SELECT fl.series_id AS user_id, e1.event_id, fl.score, fl.pred FROM fl JOIN e1 ON e1.series_id = fl.series_id AND e1.t = fl.t_end
        WHERE epoch_ms(e1.ts) <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""",
    ),
)
def _(spark, folder):
    """Events come up to 50 minutes late, so that rows of a window reach the stream in different batches."""
    cuts = scoring.fit_threshold(
        tables.window_scores(spark, folder), BY, 95.0, bound_by=tables.series_sizes(spark, folder)
    ).withColumnRenamed("series_id", "user_id")
    cuts = spread.durable(cuts)

    def build(stream):
        scored = rounded(online.score_in_order(stream, "user_id", "value", LENGTH, idle=timedelta(days=3650)), ["score"])
        return online.flag(scored, cuts, "user_id")

    late = (F.col("event_id") % 51).cast("int")
    return feed(spark, folder, build, late).select("user_id", "event_id", "score", "pred")
