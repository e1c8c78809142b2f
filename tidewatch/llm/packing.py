"""Token-ID output: best-fit-decreasing packing into fixed-length rows of binary shards.

A document's ids are cut into pieces of at most the row length (nothing is lost; a piece knows its
place). Pieces go longest first into the row with the least room that still holds them. A
segment tree over the possible capacities 0..length answers "least capacity of at least n that some row has" in
log(length) steps, whatever the number of rows. Documents are packed in blocks of about
``BLOCK_TOKENS`` ids in input order, all pieces of a document in one block, so a task holds one block
and no ids are shuffled.

A block is a file (``.npz``) of the shared folder, named and committed as ``shards`` says:
``ids`` (rows x length; the first unused id fills a row up), ``lengths`` (ids used per row), ``row_ends`` (segments up to
each row), ``cu_seqlens`` (cumulative segment lengths within each row, from 0), ``resets`` (the
column where each segment starts, so where positions start anew at 0), ``doc`` and ``piece`` of each segment, and
``doc_ids`` (JSON). Ids are 16-bit if the vocabulary allows, else 32-bit.

Null and empty texts have no ids: they are listed in ``doc_ids`` and take no segment. Null ids and repeated rows
are documents like any other. An empty table gives no file and no row. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, shards

LENGTH = 2048
BLOCK_TOKENS = 4_000_000


class ByteBpe:
    """A byte-level BPE from a file of ranks; the first id behind the vocabulary fills rows up."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pad = max(ranks.values()) + 1
        self.kind = "<u2" if self.pad < 1 << 16 else "<u4"

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), self.kind)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


class Capacities:
    """Open rows by remaining room, with a segment tree of how many rows have each room."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, room) of the row with the least room of at least ``size``; it is taken out."""
        node, count = self.leaves + size, self.count
        if not count[node]:
            # Up to the first subtree on the right that has a row, then down its left side.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        self._change(room, -1)
        return row, room


def best_fit_decreasing(sizes: Sequence[int], length: int) -> list[tuple[int, int]]:
    """(row, column) of each piece; rows are numbered in order of opening."""
    places: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    open_rows, rows = Capacities(length), 0
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        found = open_rows.take(sizes[i])
        if found is None:
            found, rows = (rows, length), rows + 1
        row, room = found
        places[i] = row, length - room
        open_rows.add(row, room - sizes[i])
    return places


def pack_block(docs: list[tuple[object, np.ndarray]], length: int, kind: str, pad: int) -> dict[str, np.ndarray]:
    """The arrays of one block of (id, ids)."""
    pieces = [(d, k, ids[k : k + length]) for d, (_, ids) in enumerate(docs) for k in range(0, len(ids), length)]
    places = best_fit_decreasing([len(p[2]) for p in pieces], length)
    rows = 1 + max((r for r, _ in places), default=-1)
    ids = np.full((rows, length), pad, kind)
    order = sorted(range(len(pieces)), key=places.__getitem__)
    lengths, ends, cumulative = np.zeros(rows, "<i4"), np.zeros(rows, "<i8"), []
    for at, i in enumerate(order):
        (row, column), part = places[i], pieces[i][2]
        ids[row, column : column + len(part)] = part
        lengths[row] = column + len(part)
        ends[row] = at + 1
        cumulative += [0] * (column == 0) + [column + len(part)]
    return {
        "ids": ids, "lengths": lengths, "row_ends": ends, "cu_seqlens": np.array(cumulative, "<i4"),
        "resets": np.array([places[i][1] for i in order], "<i4"),
        "doc": np.array([pieces[i][0] for i in order], "<i4"),
        "piece": np.array([pieces[i][1] // length for i in order], "<i4"),
        "doc_ids": np.array([json.dumps(d) for d, _ in docs], np.str_),
    }


def write(
    df: DataFrame, path: str, tokenizer: tuple[str, str], id_column: str = "doc_id", text: str = "text", length: int = LENGTH,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Encode the texts and write packed shards below ``path``; returns the manifest.

    ``tokenizer`` is a file of ranks and the pattern that cuts texts into words.
    """

    path = common.qualified(df.sparkSession, path)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = ByteBpe(*tokenizer)
        writer = shards.Writer(path, TaskContext.get().partitionId(), ".npz")
        docs, held = [], 0

        def flush():
            out = io.BytesIO()
            np.savez(out, **pack_block(docs, length, encoder.kind, encoder.pad))
            writer.write(out.getvalue(), len(docs))
            writer.close()

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(value.as_py() or "")
                docs.append((name, ids))
                held += len(ids) + 16
                if held >= block_tokens:
                    flush()
                    docs, held = [], 0
        if docs:
            flush()
        yield writer.batch()

    asked = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return shards.commit(asked.mapInArrow(save, shards.ROWS), path)


def unpack(arrays: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray, list[tuple[int, int, int]]]]:
    """(id as JSON, ids, [(row, column, length) of its pieces]) of every document of a block."""
    pieces: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rows = np.repeat(np.arange(len(arrays["row_ends"])), np.diff(arrays["row_ends"], prepend=0))
    resets, ends = arrays["resets"], arrays["cu_seqlens"][arrays["cu_seqlens"] > 0]
    for row, start, end, d, k in zip(
        rows.tolist(), resets.tolist(), ends.tolist(), arrays["doc"].tolist(), arrays["piece"].tolist(), strict=True
    ):
        pieces[d].append((k, row, start, end - start))
    for d, name in enumerate(arrays["doc_ids"].tolist()):
        mine = sorted(pieces[d])
        parts = [arrays["ids"][r, c : c + n] for _, r, c, n in mine]
        yield name, np.concatenate(parts) if parts else arrays["ids"][:0, :0].ravel(), [p[1:] for p in mine]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document read back: doc_id (JSON), n_tokens, ids_sha256, and where its pieces lie."""
    path = common.qualified(spark, path)
    schema = "doc_id string, n_tokens long, ids_sha256 string, n_pieces long, file string, row_numbers array<long>, starts array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                names, sizes, digests, rows, starts = [], [], [], [], []
                for name, ids, pieces in unpack(common.load_arrays(f"{path}/{file}")):
                    names.append(name)
                    sizes.append(len(ids))
                    digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    rows.append([p[0] for p in pieces])
                    starts.append([p[1] for p in pieces])
                columns = [
                    pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                    pa.array([len(r) for r in rows], pa.int64()), pa.array([file] * len(names), pa.string()),
                    pa.array(rows, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    files = shards.manifest(spark, path).select("file")
    return files.repartition(max(1, min(files.count(), 20_000)), "file").mapInArrow(scan, schema)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = common.scratch(spark, "packed")
    write(common.table(spark, folder, "documents"), path, default_tokenizer())
    return read(spark, path).withColumn("doc_id", F.col("doc_id").try_cast("long"))
