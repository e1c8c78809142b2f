"""Hierarchical packing into windows of several context sizes, with balanced training steps.

A document is its ids and one end id. Whole windows of the longest size are cut off it where it lies; what is left is
routed to the shortest size (tier) that holds it. Tiers are packed from the longest down. In each, the longest
piece opens a window, and its gap is filled with the longest pieces of any shorter tier that fit. Where nothing fits,
the shortest piece of a shorter tier that is longer than the gap is cut: its head closes the window, its tail
is routed anew. Where the shorter tiers are used up, the opening piece itself gives one full window of
the next size down, and its tail is routed anew. So every window is full but for what is left in the shortest tier
at the end of a task, less than one window of it. These rests are packed together in a second pass, ``MERGE``
tasks at a time; its own last window is the only one that stays short (and is padded to the longest size).

Windows of one size go to step groups of ``STEP_TOKENS`` ids: ``DEALT`` groups at a time, the windows in falling order of attention
cost (the sum of squared piece lengths) are dealt back and forth over the groups, so that groups
of a deal have equally many windows, but for one, and about equal costs.

A task packs its own rows in input order and moves no ids; only the rests are shuffled. Pieces are written as a
table once, so a lost executor repeats a task but never mixes two packings.

Null and empty texts are the end id alone. Null ids and repeated rows are documents like any other. A text of any length
is held one at a time, and beside it less than ``CELL`` ids. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

WINDOWS = (256, 512, 1024, 2048)
END = 1
# Ids that wait in a task until they are packed together.
CELL = 1_000_000
# Ids of a step group, and groups that are dealt at a time.
STEP_TOKENS = 65_536
DEALT = 16
# Tasks whose rests are packed together: less than a shortest window from each.
MERGE = 4096
# Piece rows, and bytes of their ids, that a worker hands over at once; a batch of whole windows is bounded by its bytes.
ROWS, BYTES = 5_000, 2_000_000

FIELDS = {
    "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(),
    "offset": pa.int64(), "tier": pa.int64(), "step_group": pa.int64(),
}
PIECES = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
)


@lru_cache(maxsize=1)
def _ranks(path: str, ranks_path: str, pattern: str):
    """The tokenizers library's encoder of a file, and a faster one over the same vocabulary and special tokens."""
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    return library, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids as the tokenizers library gives them.

    The faster library gives the same ids (``test_tiers.py`` compares them on every code point); it refuses some very long runs
    of white space, which the tokenizers library encodes.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        self.library, self.fast = _ranks(path, ranks_path, pattern)

    def ids(self, text: str) -> np.ndarray:
        try:
            out = self.fast.encode(text, allowed_special="all")
        except ValueError:
            out = self.library.encode(text, add_special_tokens=False).ids
        out.append(END)
        return np.array(out, "<u4")


def default_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers as p

    return str(p.path("byte_bpe_50k.json")), str(p.path("byte_bpe_50k.tiktoken")), p.PATTERN


class Piece:
    """Ids of a document from ``start`` on."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc: object, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        rest = Piece(self.doc, self.start + at, self.ids[at:], self.total)
        return Piece(self.doc, self.start, self.ids[:at], self.total), rest


class Pool:
    """Pieces by length; a bit per length that is there answers which length is next."""

    def __init__(self):
        self.there = 0
        self.by: dict[int, list[Piece]] = defaultdict(list)

    def add(self, piece: Piece) -> None:
        n = len(piece.ids)
        self.by[n].append(piece)
        self.there |= 1 << n

    def longest(self, upto: int) -> int:
        """The greatest length of at most ``upto``, or 0."""
        return (self.there & ((2 << upto) - 1)).bit_length() - 1 if self.there & ((2 << upto) - 1) else 0

    def shortest(self, above: int, upto: int) -> int:
        """The least length of more than ``above`` and at most ``upto``, or 0."""
        found = (self.there & ((2 << upto) - 1)) >> (above + 1)
        return (found & -found).bit_length() + above if found else 0

    def take(self, n: int) -> Piece:
        mine = self.by[n]
        piece = mine.pop()
        if not mine:
            self.there &= ~(1 << n)
        return piece


def pack_tiers(pool: Pool, windows: Sequence[int]) -> Iterator[tuple[int, list[Piece]]]:
    """(size, pieces) of full windows; what would not fill a shortest window stays in the pool."""
    for lower, size in list(zip((0, *windows), windows, strict=False))[::-1]:
        while (n := pool.longest(size)) > lower:
            window, gap = [pool.take(n)], size - n
            while gap and (m := pool.longest(gap)):
                window.append(pool.take(m))
                gap -= m
            if gap and (m := pool.shortest(gap, lower or size)):
                head, rest = pool.take(m).cut(gap)
                window.append(head)
                pool.add(rest)
                gap = 0
            if not gap:
                yield size, window
                continue
            if not lower:
                for piece in window:
                    pool.add(piece)
                return
            head, rest = window[0].cut(lower)
            yield lower, [head]
            for piece in (rest, *window[1:]):
                pool.add(piece)


def deal(costs: Sequence[int], groups: int) -> list[int]:
    """The group of each window: back and forth in falling order of cost."""
    out = [0] * len(costs)
    for at, i in enumerate(sorted(range(len(costs)), key=lambda j: (-costs[j], j))):
        turn, column = divmod(at, groups)
        out[i] = groups - 1 - column if turn % 2 else column
    return out


class Steps:
    """Numbers windows and deals them to step groups; ``base`` keeps the numbers of tasks apart."""

    def __init__(self, base: int, step_tokens: int):
        self.sequence = self.group = base
        self.step_tokens = step_tokens
        self.waiting: dict[int, list[list[Piece]]] = defaultdict(list)
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, size: int, window: list[Piece]) -> None:
        self.waiting[size].append(window)
        if len(self.waiting[size]) >= DEALT * max(1, self.step_tokens // size):
            self.flush(size)

    def flush(self, size: int) -> None:
        windows = self.waiting.pop(size, [])
        if not windows:
            return
        groups = -(-len(windows) // max(1, self.step_tokens // size))
        chosen = deal([sum(len(p.ids) ** 2 for p in w) for w in windows], groups)
        for window, group in zip(windows, chosen, strict=True):
            offset = 0
            for p in window:
                row = (p.doc, p.start, len(p.ids), p.ids.tobytes(), p.total, self.sequence, offset, size, self.group + group)
                self.rows.append(row)
                offset += len(p.ids)
            self.held += 4 * offset
            self.sequence += 1
        self.group += groups

    def end(self) -> None:
        for size in list(self.waiting):
            self.flush(size)

    def take(self) -> list[tuple]:
        rows, self.rows, self.held = self.rows, [], 0
        return rows


def _batch(rows: list[tuple], kind: pa.DataType, name: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * (1 + len(FIELDS))
    arrays = [pa.array(c, k) for c, k in zip(columns, (kind, *FIELDS.values()), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name, *FIELDS])


def _slices(rows: list[tuple]) -> Iterator[list[tuple]]:
    at, size = 0, 0
    for upto, row in enumerate(rows):
        if upto > at and (upto - at >= ROWS or size + len(row[3]) > BYTES):
            yield rows[at:upto]
            at, size = upto, 0
        size += len(row[3])
    if at < len(rows):
        yield rows[at:]


def pack(
    df: DataFrame, tokenizer: tuple[str, str, str], id_column: str = "doc_id", text: str = "text",
    windows: Sequence[int] = WINDOWS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: the id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset, tier, step_group.

    ``tokenizer`` is a file of the tokenizers library, one with its ranks, and its word pattern. ``windows`` rise. The only
    windows that are not full have the tier of the longest, to which they are padded.
    """
    if list(windows) != sorted(set(windows)) or min(windows) < 1:
        raise ValueError("window sizes must rise")
    top = windows[-1]
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, {PIECES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, steps, pool, held, arrow = Encoder(*tokenizer), Steps(task << 36, step_tokens), Pool(), 0, None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(value.as_py() or "")
                whole = len(ids) - len(ids) % top
                for at in range(0, whole, top):
                    steps.add(top, [Piece(doc, at, ids[at : at + top], len(ids))])
                if whole < len(ids):
                    # A copy, so that a long document's other ids are not kept with its tail.
                    pool.add(Piece(doc, whole, ids[whole:].copy(), len(ids)))
                    held += len(ids) - whole
                if held >= CELL:
                    for size, window in pack_tiers(pool, windows):
                        steps.add(size, window)
                    held = 0
                if steps.held >= BYTES or len(steps.rows) >= ROWS:
                    for rows in _slices(steps.take()):
                        yield _batch(rows, arrow, "id")
        if arrow is None:
            return
        for size, window in pack_tiers(pool, windows):
            steps.add(size, window)
        steps.end()
        rest = [p for n in sorted(pool.by) for p in pool.by[n]]
        # What is left has no window yet; its tier holds the task.
        left = [(p.doc, p.start, len(p.ids), p.ids.tobytes(), p.total, None, None, task, None) for p in rest]
        for rows in _slices(steps.take() + left):
            yield _batch(rows, arrow, "id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, steps, names = [], None, None
        for batch in batches:
            names = batch.schema
            rows += batch.to_pylist()
        if names is None:
            return
        rows.sort(key=lambda r: (r["tier"], r["at"]))
        steps, pool = Steps(1 << 61 | rows[0]["tier"] // MERGE << 36, step_tokens), Pool()
        for r in rows:
            pool.add(Piece(r["id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
        for size, window in pack_tiers(pool, windows):
            steps.add(size, window)
        steps.end()
        if last := [p for n in sorted(pool.by) for p in pool.by[n]]:
            steps.add(top, last)
            steps.end()
        for part in _slices(steps.take()):
            yield _batch(part, names.field("id").type, "id")

    asked = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    pieces = common.stored(asked.mapInArrow(run, schema))
    rest = pieces.where("sequence_id IS NULL").withColumn("at", F.monotonically_increasing_id())
    cells = rest.groupBy(F.expr(f"tier div {MERGE}").alias("cell"))
    merged = cells.applyInArrow(_table(merge), schema)
    return pieces.where("sequence_id IS NOT NULL").unionByName(merged).withColumnRenamed("id", id_column)


def _table(run):
    """A function of one group's table from one of its batches."""

    def of(table: pa.Table) -> pa.Table:
        out = list(run(iter(table.combine_chunks().to_batches())))
        return pa.Table.from_batches(out)

    return of


def sequences(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per window: sequence_id, tier, step_group, ids, n_tokens, cu_seqlens (ends of its segments after a 0), documents.

    A window holds at most as many pieces as ids, so a row stays bounded. Positions start anew at each of cu_seqlens.
    """
    part = F.struct("offset", "length", "ids", F.col(id_column).alias("doc"))
    rows = pieces.groupBy("sequence_id", "tier", "step_group").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.aggregate(F.transform("parts", lambda p: F.hex(p["ids"])), F.lit(""), lambda a, b: F.concat(a, b))
    ends = F.transform("parts", lambda p: p["offset"] + p["length"])
    return rows.select(
        "sequence_id", "tier", "step_group", F.unhex(joined).alias("ids"), F.element_at(ends, -1).alias("n_tokens"),
        F.concat(F.array(F.lit(0).cast("long")), ends).alias("cu_seqlens"), F.col("parts.doc").alias("documents"),
    )


def op13_tiers(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(common.table(spark, folder, "documents"), default_tokenizer())
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select(
        "doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )
