"""Keep ordered work spread over the cluster when one series holds most of the rows.

Three tools:

* a dense integer ``t`` is cut into buckets of ``BUCKET`` steps, so that no window ever
  orders more than one bucket (plus the reach of its frame) in one task;
* any other order (scores, timestamps) is range partitioned when a group is too large
  for one task, and the running sums of the parts are joined up afterwards;
* per-series statistics are broadcast after their rows were counted, else salted.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Steps of t that one task orders.
BUCKET = 65_536
# Rows of one group that one task may order.
GROUP_LIMIT = 4_000_000
# Rows, and bytes of their Parquet files, that may be broadcast.
LOOKUP_LIMIT = 500_000
LOOKUP_BYTES = 64 << 20
# Copies of the small side when it is too large to broadcast.
SALTS = 32

def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees; a temporary one only where the driver is the executor."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
    return sc.getCheckpointDir()


# Paths stored inside open ``job`` blocks, innermost last.
_open_jobs: list[list[str]] = []


@contextlib.contextmanager
def job(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that ``durable`` stored inside the block, but for those stored by the yielded function."""
    paths: list[str] = []
    _open_jobs.append(paths)

    def keep(df: DataFrame) -> DataFrame:
        out = durable(df)
        path = paths.pop()
        if len(_open_jobs) > 1:
            _open_jobs[-2].append(path)
        return out

    try:
        yield keep
    finally:
        _open_jobs.pop()
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table or file, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: computed once, safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tidewatch/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open_jobs:
        _open_jobs[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and of all."""
    if not by:
        n = df.count()
        return n, n
    r = df.groupBy(*by).count().agg(F.max("count").alias("top"), F.sum("count").alias("n")).first()
    return r.top or 0, r.n or 0


def has_hot_group(df: DataFrame, by: Sequence[str], limit: int | None = None) -> bool:
    """Whether some group of ``by`` has more rows than one task should order."""
    return group_sizes(df, by)[0] > (GROUP_LIMIT if limit is None else limit)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums in ``order`` (a total order within each group of ``by``).

    ``bound_by`` is a cheaper frame with at least as many rows per group as ``df``; the
    group sizes are then counted there.
    """
    by = list(by)
    largest, rows = group_sizes(df if bound_by is None else bound_by, by)
    if largest <= (GROUP_LIMIT if limit is None else limit):
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(frame).alias(n) for n, c in totals.items()])

    addends = {f"_add_{n}": c for n, c in totals.items()}
    # No part has more rows than a task may order.
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = durable(
        df.withColumns(addends)
        .repartitionByRange(max(usual, -(-rows // GROUP_LIMIT)), *[F.col(c) for c in by], *order)
        .withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*by, "_part")
        .agg(*[F.sum(a).alias(a) for a in addends])
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in by],
            F.col("_part").alias("_k_part"),
            *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"_off{a}") for a in addends],
        )
    )
    same = F.col("_part") == F.col("_k_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(offsets, same).select(
        *df.columns,
        *[(F.sum(f"_add_{n}").over(within) + F.col(f"_off_add_{n}")).alias(n) for n in totals],
    )


def row_index(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "t",
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """Dense 0-based position of every row within its series."""
    keys = [F.col(c) for c in order]
    if bound_by is None:
        bound_by = df.select(*by)
    out = running_totals(df, by, keys, {name: F.lit(1)}, limit, bound_by)
    return out.withColumn(name, F.col(name).cast("bigint") - 1)


def bucket_of(t: str = "t", size: int | None = None) -> Column:
    return F.floor(F.col(t) / F.lit(size or BUCKET))


def with_halo(df: DataFrame, before: int, after: int = 0, t: str = "t", size: int | None = None) -> DataFrame:
    """Copy each row into every bucket whose frames reach it.

    Adds ``_bucket`` and ``_home`` (true for the one copy that belongs to the bucket).
    Windows over ``(series, _bucket)`` order by t are exact on the ``_home`` rows for
    frames of at most ``before`` preceding and ``after`` following steps.
    """
    size = size or BUCKET
    if size < before + after:
        raise ValueError("bucket is smaller than the frame")
    home = F.floor(F.col(t) / F.lit(size))
    first = F.greatest(F.floor((F.col(t) - F.lit(after)) / F.lit(size)), F.lit(0).cast("bigint"))
    last = F.floor((F.col(t) + F.lit(before)) / F.lit(size))
    return df.withColumn("_bucket", F.explode(F.sequence(first, last))).withColumn("_home", F.col("_bucket") == home)


def bucket_frame(by: Sequence[str], t: str = "t"):
    return Window.partitionBy(*by, "_bucket").orderBy(t)


def windowed(
    df: DataFrame,
    by: Sequence[str],
    before: int,
    after: int,
    columns: Mapping[str, Column] | None = None,
    build=None,
    t: str = "t",
    size: int | None = None,
) -> DataFrame:
    """Add window columns with a bounded frame; ``build(window)`` gives name -> Column."""
    halo = with_halo(df, before, after, t, size)
    added = build(bucket_frame(by, t))
    return halo.withColumns(added).where("_home").select(*df.columns, *added)


def bucket_running(
    df: DataFrame,
    by: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    t: str = "t",
    size: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Inclusive running sums / maxima along t, one bucket per task.

    The rows are shuffled once; bucket totals and rows come from the same exchange. Rows with a null
    key or t are dropped, or with ``how`` left kept, each with its own bucket's values alone.
    """
    by = list(by)
    sums, maxima = dict(sums or {}), dict(maxima or {})
    df = df.withColumn("_bucket", bucket_of(t, size)).repartition(*by, "_bucket")
    per_bucket = df.groupBy(*by, "_bucket").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxima.items()]
    )
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.max(n).over(earlier).alias(f"_off_{n}") for n in maxima],
    )
    within = bucket_frame(by, t).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in df.columns if c != "_bucket"]
    return df.join(offsets, [*by, "_bucket"], how).select(
        *kept,
        *[(F.sum(c).over(within) + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(n) for n, c in sums.items()],
        *[F.greatest(F.max(c).over(within), F.col(f"_off_{n}")).alias(n) for n, c in maxima.items()],
    )


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files a stored table is read from."""
    spark, total = df.sparkSession, 0
    for file in df.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return total


def join_null_safe(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", many: bool = False) -> DataFrame:
    """Equi-join in which null keys meet null keys; the columns of ``on`` come from ``df``.

    With ``many`` no side is broadcast: Spark goes by the bytes of files, and a few MB of them may hold millions of rows.
    """
    keys = {c: f"_on_{c}" for c in on}
    renamed = small.withColumnsRenamed(keys)
    if many:
        renamed = renamed.hint("merge")
    same = F.lit(True)
    for c, k in keys.items():
        same = same & df[c].eqNullSafe(renamed[k])
    return df.join(renamed, same, how).drop(*keys.values())


def salt_of(df: DataFrame, salts: int = SALTS) -> Column:
    """A number below ``salts`` from all columns of a row that can be hashed (maps cannot)."""
    plain = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")


def lookup_join(
    df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", limit: int | None = None
) -> DataFrame:
    """Join rows with fitted per-series values: broadcast if they are few and small, else salted.

    The fitted side is stored once, so that counting it does not compute it twice. ``how`` is
    inner, left, left_semi or left_anti; null keys meet null keys.
    """
    limit = LOOKUP_LIMIT if limit is None else limit
    on = list(on)
    if not on:
        df, small, on = df.withColumn("_one", F.lit(1)), small.withColumn("_one", F.lit(1)), ["_one"]
    small = durable(small)
    if small.count() <= limit and stored_bytes(small) <= LOOKUP_BYTES:
        out = join_null_safe(df, F.broadcast(small), on, how)
    else:
        copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = join_null_safe(df.withColumn("_salt", salt_of(df)), copies, [*on, "_salt"], how, many=True).drop("_salt")
    return out.drop("_one")


def percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    points: Sequence[float],
    limit: int | None = None,
    bound_by: DataFrame | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles per group: columns ``by`` + ``q`` (array)."""
    by = list(by)
    points = [float(p) for p in points]
    if not has_hot_group(df if bound_by is None else bound_by, by, limit):
        ask = F.percentile(F.col(value), F.array(*[F.lit(p) for p in points]))
        return df.groupBy(*by).agg(ask.alias("q"))

    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(counts, by, [F.col(value)], {"_upto": F.col("_n")}, limit)
    ranked = lookup_join(ranked, counts.groupBy(*by).agg(F.sum("_n").alias("_all")), by)
    picks = []
    for i, p in enumerate(points):
        at = (F.col("_all") - 1) * F.lit(p)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.min(F.when(F.col("_upto") >= pos + 1, F.col(value))).alias(f"_{side}{i}"))
    picked = ranked.groupBy(*by).agg(F.max("_all").alias("_all"), *picks)
    parts = []
    for i, p in enumerate(points):
        at, lo, hi = (F.col("_all") - 1) * F.lit(p), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        # The other route's order of operations, so that both give the same number.
        between = (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi
        parts.append(F.when(lo == hi, lo).otherwise(between).cast("double"))
    found = picked.select(*by, F.array(*parts).alias("q"))
    if not by:
        return found
    # A group whose values are all null has a row, without percentiles.
    return join_null_safe(df.select(*by).distinct(), found, by, "left")
