"""Readers for the file layouts series and labels come in."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.operators import prepare, spread, windows

FILE = ["_file", "_start"]


# ---- row order of text files ----------------------------------------------------------


def with_place(scan: DataFrame) -> DataFrame:
    """Note where each row of a file scan was read: file, split start, and order within the split."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
    )


def natural(path: Column) -> Column:
    """A path with its numbers padded, so that text order is the order of the numbers."""
    parts = F.regexp_extract_all(F.concat(path, F.lit(" ")), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 40, "0")).otherwise(p)), "")


def file_ranks(scan: DataFrame) -> DataFrame:
    """(_file, _rank): the files of a scan in order of the numbers in their names, as ``file_order`` puts them."""
    files = scan.select(F.col("_metadata.file_path").alias("_file")).distinct()
    order = Window.orderBy(natural(F.col("_file")), "_file")
    return files.select("_file", F.row_number().over(order).alias("_rank"))


def place_order() -> list[Column]:
    return [natural(F.col("_file")), F.col("_file"), F.col("_start")]


def file_order(placed: DataFrame, by: Sequence[str], name: str = "t") -> DataFrame:
    """Dense row number in (file, position) order within each group of ``by``.

    Files are in order of the numbers in their names (part-99999 before part-100000), then of
    the names. A split is read by one task, front to back, so that lines are numbered split by split
    and the sizes of the earlier splits are added. No file has to fit into one task. Every
    group must consist of whole splits.
    """
    by = list(by)
    split = [*by, *FILE]
    counts = placed.groupBy(*split).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(*place_order()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*split).orderBy("_line")
    numbered = placed.join(offsets, split)
    t = (F.row_number().over(within) - 1 + F.col("_off")).cast("bigint")
    return numbered.withColumn(name, t).drop(*FILE, "_line", "_off")


def entity_name(path: Column, folders: bool = False) -> Column:
    """Name of the series: the file name without .txt, or the folder the file lies in."""
    parts = F.split(path, "/")
    if folders:
        return F.regexp_replace(F.get(parts, F.size(parts) - 2), "^[^=]*=", "")
    return F.regexp_replace(F.get(parts, F.size(parts) - 1), r"\.(txt|csv|npy)$", "")


# ---- matrices -------------------------------------------------------------------------


def matrix(spark: SparkSession, path: str, folders: bool = False, features: Sequence[str] | None = None) -> DataFrame:
    """Headerless number files, one line per step: (series_id, t, values).

    One file per entity, or with ``folders`` one folder of part files per entity. With
    ``features`` the values become columns of these names.
    """
    placed = with_place(spark.read.option("recursiveFileLookup", "true").text(path))
    placed = placed.withColumn("series_id", entity_name(F.col("_file"), folders)).where("trim(value) <> ''")
    rows = file_order(placed, ["series_id"])
    values = F.transform(F.split("value", ","), lambda c: F.nullif(F.trim(c), F.lit("")).cast("double"))
    if features is None:
        return rows.select("series_id", "t", values.alias("values"))
    return rows.select("series_id", "t", *[F.get(values, F.lit(i)).alias(f) for i, f in enumerate(features)])


def point_labels(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """One 0/1 per line: (series_id, t, y)."""
    return matrix(spark, path, folders, ["y"]).withColumn("y", F.col("y").cast("int"))


def entities(spark: SparkSession, path: str, suffix: str = ".txt", folders: bool = False) -> DataFrame:
    """Sorted names of the entities found; empty when there is no such folder."""
    from py4j.protocol import Py4JError
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([], "series_id string")
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", f"*{suffix}")
            .load(path)
        )
    except (AnalysisException, Py4JError):
        return empty
    names = files.select(entity_name(F.col("path"), folders).alias("series_id"))
    return names.distinct().orderBy("series_id")


def npy_rows(files: DataFrame) -> DataFrame:
    """(path, content) of two-dimensional .npy files as (series_id, t, values).

    An array file is one unit; it is parsed where Spark placed it and streamed out in slices.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                array = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False).astype(float))
                name = re.sub(r"\.npy$", "", path.rsplit("/", 1)[-1])
                for at in range(0, len(array), 4096):
                    part = array[at : at + 4096]
                    yield pd.DataFrame({"series_id": name, "t": np.arange(at, at + len(part)), "values": list(part)})

    return files.select("path", "content").mapInPandas(parse, "series_id string, t bigint, values array<double>")


def npy(spark: SparkSession, path: str) -> DataFrame:
    return npy_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path))


# ---- labels ---------------------------------------------------------------------------

CHANNELS = "chan_id string, spacecraft string, anomaly_sequences string, class string, num_values int"


def channel_table(spark: SparkSession, path: str) -> DataFrame:
    """The labelled-interval table in file order (column ``row``)."""
    names = [f.name for f in T.StructType.fromDDL(CHANNELS)]
    scan = spark.read.csv(path, header=True)
    missing = [n for n in names if n not in scan.columns and n != "class"]
    if missing:
        raise ValueError(f"label table lacks {missing}")
    placed = with_place(scan).withColumn("_all", F.lit(0))
    ordered = file_order(placed, ["_all"], "row")
    return ordered.select("chan_id", "spacecraft", "anomaly_sequences", F.col("num_values").cast("int").alias("num_values"), "row")


def channels(table: DataFrame, spacecraft: str | None = None) -> DataFrame:
    """Distinct channels in file order, optionally of one spacecraft."""
    if spacecraft is not None:
        table = table.where(F.col("spacecraft") == spacecraft)
    return table.groupBy("chan_id").agg(F.min("row").alias("row")).orderBy("row").select("chan_id")


def channel_rows(table: DataFrame, spacecraft: str | None = None, channel: str | None = None) -> DataFrame:
    if spacecraft is not None:
        table = table.where(F.col("spacecraft") == spacecraft)
    return table if channel is None else table.where(F.col("chan_id") == channel)


def intervals(table: DataFrame, channel: str | None = None) -> DataFrame:
    """(series_id, seg_id, start_t, end_t, n): intervals of each channel's first row, ends included.

    Asking for a channel that is not there is an error.
    """
    if channel is not None:
        table = table.where(F.col("chan_id") == channel)
        if not table.take(1):
            raise ValueError(f"no labels for channel {channel}")
    first = table.groupBy("chan_id").agg(
        F.min_by(F.struct("anomaly_sequences", "num_values"), "row").alias("_r")
    )
    pairs = F.from_json("_r.anomaly_sequences", "array<array<bigint>>")
    spans = first.select(
        F.col("chan_id").alias("series_id"), F.col("_r.num_values").alias("n"), F.posexplode(pairs).alias("seg_id", "p")
    )
    return spans.select("series_id", "seg_id", F.col("p")[0].alias("start_t"), F.col("p")[1].alias("end_t"), "n")


def dim_intervals(lines: DataFrame, series: str = "series_id", text: str = "value") -> DataFrame:
    """Lines ``start-end:d1,d2,…`` as (series_id, start_t, end_t, dims)."""
    spans = lines.where(F.trim(text) != "").select(
        F.col(series).alias("series_id"),
        F.regexp_extract(text, r"^\s*(\d+)-(\d+):", 1).cast("bigint").alias("start_t"),
        F.regexp_extract(text, r"^\s*(\d+)-(\d+):", 2).cast("bigint").alias("end_t"),
        F.transform(F.split(F.regexp_extract(text, r":(.*)$", 1), ","), lambda d: F.trim(d).cast("int")).alias("dims"),
    )
    return spans


def interpretation_labels(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """Interval files with contributing dimensions, one file (or with ``folders`` one folder) per machine."""
    scan = spark.read.option("recursiveFileLookup", "true").text(path)
    name = entity_name(F.col("_metadata.file_path"), folders)
    return dim_intervals(scan.select("value", name.alias("series_id")))


def labelled_channels(spark: SparkSession, path: str, labels: str) -> DataFrame:
    """Array files with their interval labels in one load: (series_id, t, values, y).

    Intervals are clipped to the length of the series that was read; a channel without intervals is 0
    throughout, and intervals of a channel without a file are left out.
    """
    rows = npy(spark, path)
    spans = intervals(channel_table(spark, labels)).select("series_id", "start_t", "end_t")
    return windows.paint_segments(rows, spans, ["series_id"])


# ---- plant and cluster tables ---------------------------------------------------------


def plant_csv(
    spark: SparkSession,
    path: str,
    features: Sequence[str] | None = None,
    on_bad: str = "raise",
    timestamp: str = "Timestamp",
    label: str = "Normal/Attack",
    time_format: str = "dd/MM/yyyy hh:mm:ss a",
) -> DataFrame:
    """Headed plant log: (t, y, features…) with t the position in time order.

    Header names are stripped and the split spelling of the attack label is mended.
    ``on_bad``: ``raise`` on a value that is no number, or ``impute`` it along t.
    ``features`` is the feature list of the normal file; by default every other column.
    """
    scan = spark.read.csv(path, header=True)
    names = [c.strip() for c in scan.columns]
    placed = with_place(scan)
    placed = placed.toDF(*names, *placed.columns[len(names) :])
    features = [c for c in names if c not in (timestamp, label)] if features is None else list(features)
    absent = [c for c in [timestamp, label, *features] if c not in names]
    if absent:
        raise ValueError(f"plant table lacks columns {absent}")
    rows = placed.select(
        F.try_to_timestamp(F.trim(F.col(f"`{timestamp}`")), F.lit(time_format)).alias("_ts"),
        prepare.attack_flag(F.col(f"`{label}`")).alias("y"),
        *[prepare.coerce_numeric(F.trim(F.col(f"`{c}`"))).alias(c) for c in features],
        *FILE,
        "_line",
    )
    # Files are numbered once, so that no row carries its path into the sort.
    ranked = spread.lookup_join(rows, file_ranks(scan), ["_file"], "left").drop("_file")
    ordered = spread.row_index(ranked, [], ["_ts", "_rank", "_start", "_line"]).drop("_ts", "_rank", "_start", "_line")
    if on_bad == "raise":
        return prepare.assert_no_nan(ordered, features)
    if on_bad != "impute":
        raise ValueError(f"on_bad is raise or impute, not {on_bad!r}")
    one = ordered.withColumn("_all", F.lit(0))
    return prepare.interpolate(one, ["_all"], features).drop("_all")


def head_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of the first file in file order."""
    scan = spark.read.option("recursiveFileLookup", "true").text(path)
    files = scan.select(F.col("_metadata.file_path").alias("_file")).distinct()
    first = files.orderBy(natural(F.col("_file")), "_file").first()
    if first is None:
        return []
    placed = with_place(spark.read.text(first["_file"]))
    return [r.value for r in placed.orderBy("_start", "_line").limit(n).collect()]


def multiheader(
    spark: SparkSession,
    path: str,
    series_id: str = "all",
    drop: Sequence[str] = ("date", "label"),
    header: tuple[Sequence[str], Sequence[str]] | None = None,
) -> DataFrame:
    """CSV with two header lines (host, metric): (series_id, t, node, metric, x).

    The header stands in the first file by name, or is given as ``header`` for files without one.
    Columns whose host or metric name is in ``drop`` are left out.
    """
    if header is None:
        lines = head_lines(spark, path, 2)
        if len(lines) < 2:
            raise ValueError(f"{path} has no two header lines")
        first, second = (line.split(",") for line in lines)
    else:
        first, second = header
    skip = 0 if header else 2
    names = [f"c{i}" for i in range(len(first))]
    scan = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    placed = with_place(scan).withColumn("series_id", F.lit(series_id))
    rows = file_order(placed, ["series_id"]).where(f"t >= {skip}").withColumn("t", F.col("t") - skip)
    cells = [
        F.struct(F.lit(h.strip()).alias("node"), F.lit(m.strip()).alias("metric"), F.col(n).try_cast("double").alias("x"))
        for n, h, m in zip(names, first, second)
        if h.strip() not in drop and m.strip() not in drop
    ]
    return rows.select("series_id", "t", F.inline(F.array(*cells)))


def edges(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Topology as (src, dst)."""
    scan = spark.read.csv(path, header=True) if form == "csv" else spark.read.format(form).load(path)
    return scan.select("src", "dst")
