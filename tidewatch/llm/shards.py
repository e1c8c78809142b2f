"""Files that tasks write: temporary names first, then a manifest, then their names.

A task writes below ``_temporary`` under a name of its own attempt and returns one row per file. Those
rows go through a written table, so that exactly one attempt of each task counts. A second
job gives the files their names (a file that already has its name and size is left alone, so the
job may run again), and the manifest, a Parquet table whose success mark commits the whole, is
written last. What failed attempts left is removed with ``_temporary``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import common

ROWS = "shard long, file string, temporary string, records long, bytes long, sha256 string"


class Writer:
    """Numbered files of one shard in one task attempt."""

    def __init__(self, path: str, shard: int, suffix: str):
        self.system, self.root = common.file_system(path)
        self.shard, self.suffix = shard, suffix
        self.attempt = f"_temporary/{shard:06d}-{uuid.uuid4().hex}"
        self.rows: list[tuple] = []
        self.out = None

    def write(self, data: bytes, records: int = 1) -> None:
        if self.out is None:
            self.name = f"{self.shard:06d}-{len(self.rows):05d}{self.suffix}"
            self.system.create_dir(f"{self.root}/{self.attempt}", recursive=True)
            self.out = self.system.open_output_stream(f"{self.root}/{self.attempt}/{self.name}")
            self.bytes = self.records = 0
            self.digest = hashlib.sha256()
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)
        self.records += records

    @property
    def size(self) -> int:
        return self.bytes if self.out is not None else 0

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            temporary = f"{self.attempt}/{self.name}"
            self.rows.append((self.shard, self.name, temporary, self.records, self.bytes, self.digest.hexdigest()))

    def batch(self) -> pa.RecordBatch:
        self.close()
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in kinds]
        names = [f.split()[0] for f in ROWS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def commit(written: DataFrame, path: str) -> DataFrame:
    """Run the writing job, name its files, write the manifest; returns the manifest."""
    spark = written.sparkSession

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = common.file_system(path)
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{root}/{row['file']}"
                if system.get_file_info(target).size != row["bytes"]:
                    system.move(f"{root}/{row['temporary']}", target)
            yield batch.select([f.split()[0] for f in ROWS.split(", ") if "temporary" not in f])

    with common.tidy(spark):
        once = common.stored(written)
        kept = ROWS.replace("temporary string, ", "")
        once.mapInArrow(name, kept).write.parquet(f"{path}/manifest")
    from tidewatch.operators import spread

    spread.remove(spark, f"{path}/_temporary")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS.replace("temporary string, ", "")).parquet(f"{path}/manifest")
