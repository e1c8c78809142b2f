"""Tables, shared files and committed shards of the training-data operators."""

from __future__ import annotations

import contextlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import spread

# Spark's settings that delete an action's shuffle files once it has ended.
CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")

# Names of a store in Hadoop that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the file system that Spark finds it on, so that tasks don't look on their own disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return qualified(spark, f"{spread.shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files behind; what they keep is written as tables."""
    before = {k: spark.conf.get(k, None) for k in CLEANUP}
    for k in CLEANUP:
        spark.conf.set(k, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame) -> DataFrame:
    """A written table, without the shuffle files of its making."""
    with tidy(df.sparkSession):
        return spread.durable(df)


def file_system(uri: str):
    """The file system of a qualified path and the path in it.

    Spark's names of a store are put as pyarrow knows them; a path without a scheme is refused, since it
    would mean another place in each task, and so is a store that pyarrow can't open.
    """
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{uri} names no file system; qualify it on the driver")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def put(uri: str, data: bytes) -> None:
    """Write a file under a temporary name, then give it its name."""
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{path}.tmp") as out:
        out.write(data)
    system.move(f"{path}.tmp", path)


def get(uri: str) -> bytes:
    system, path = file_system(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def save_arrays(uri: str, **arrays: np.ndarray) -> str:
    out = io.BytesIO()
    np.savez(out, **arrays)
    put(uri, out.getvalue())
    return uri


def load_arrays(uri: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(get(uri)), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of an id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def most_frequent(counts: DataFrame, most: int) -> list[tuple]:
    """(w, c) by falling count, then by word: at most ``most``, all words of a count or none.

    The least count comes from the numbers of words per count, so that no task sorts the words.
    """
    with tidy(counts.sparkSession):
        sizes = counts.groupBy("c").count().orderBy(F.desc("c")).limit(most).collect()
        least, total = None, 0
        for r in sizes:
            total += r["count"]
            if total > most:
                break
            least = r["c"]
        if least is None:
            return []
        rows = counts.where(F.col("c") >= least).collect()
    pairs = [(bytes(r.w) if isinstance(r.w, bytearray) else r.w, r.c) for r in rows]
    return sorted(pairs, key=lambda p: (-p[1], p[0]))
