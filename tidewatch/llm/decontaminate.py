"""Benchmark decontamination by Wu-Manber search for many test strings at once.

A text becomes the byte string `` w1 w2 ... `` of its words (lower case, one space around each), so
that a window of words occurs exactly where its byte string occurs. Windows are grouped by length.
In a group with the shortest length m, a block of B bytes that ends at position p of the text
tells how far the search may jump: a table indexed by the block's hash holds the distance from the
last place where that block occurs in the first m bytes of any window, m - B + 1 if nowhere. Where
the distance is 0, the block's bucket gives the windows to compare byte by byte. The text of a batch
is searched from many starting points in step, each at its own jumps, in numpy; the confirmation is
exact, whatever the hash tables say.

Windows are cut into table blocks of at most ``BLOCK_WINDOWS`` that lie in the shared folder; a task
holds one block's tables at a time and goes through all of them for each batch, so that neither
the driver's nor an executor's memory grows with the benchmark. Documents are never shuffled.

Null and empty texts have no words; an item of fewer words than a window, but not none, is one
window. Repeated items and repeated documents give the same answer as one; an item with a null id is
named ``null``. An empty benchmark leaves all documents clean. Columns other than id and text are
not read by ``mark`` and are carried along by ``clean``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

WINDOW = 10
BLOCK_WINDOWS = 100_000
# Jump tables have 2**TABLE_BITS entries, blocks up to BLOCK_BYTES bytes.
TABLE_BITS = 20
BLOCK_BYTES = 8
# Starting points that advance together, and the least stretch of text for each.
CURSORS, STRETCH = 8192, 512
# Rows to search at once, in bytes of text.
CHUNK = 16 << 20

# A-Z become a-z; bytes that are in no word become spaces.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """The byte strings of all windows of ``size`` words; of all words if they are fewer."""
    if not words:
        return []
    return [b" %s " % b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def block_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes that end at each position from size - 1 on."""
    n = len(data) - size + 1
    value = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        value = value * np.uint64(257) + data[i : i + n]
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Group:
    """Windows of similar length with their jump table and suffix buckets."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.b = min(BLOCK_BYTES, self.m)
        self.jump = np.full(1 << TABLE_BITS, self.m - self.b + 1, np.int32)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        for end in range(self.b - 1, self.m):
            last = np.ascontiguousarray(heads[:, end - self.b + 1 : end + 1])
            at = np.zeros(len(patterns), np.uint64)
            for i in range(self.b):
                at = at * np.uint64(257) + last[:, i]
            at = ((at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            np.minimum.at(self.jump, at, self.m - 1 - end)
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            self.buckets[p[self.m - self.b : self.m]].append(p)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, window) of every occurrence in text."""
        data = np.frombuffer(text, np.uint8)
        if len(data) < self.m:
            return
        stretch = max(STRETCH, -(-len(data) // CURSORS))
        at = np.arange(self.m - 1, len(data), stretch, dtype=np.int64)
        end = np.minimum(at + stretch, len(data))
        back = np.arange(self.b - 1, -1, -1)
        stops = []
        while len(at):
            value = np.zeros(len(at), np.uint64)
            for i in back:
                value = value * np.uint64(257) + data[at - i]
            value = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)
            jump = self.jump[value.astype(np.int64)]
            stop = jump == 0
            if stop.any():
                stops.append(at[stop])
            at = at + np.maximum(jump, 1)
            on = at < end
            at, end = at[on], end[on]
        for p in np.sort(np.concatenate(stops)).tolist() if stops else ():
            start = p - self.m + 1
            for pattern in self.buckets.get(text[p - self.b + 1 : p + 1], ()):
                if text.startswith(pattern, start):
                    yield start, pattern


class Patterns:
    """The windows of one table block, and which items each belongs to."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        for window, item in rows:
            self.items[window].add(item)
        by_length = defaultdict(list)
        for window in self.items:
            by_length[len(window).bit_length()].append(window)
        self.groups = [Group(sorted(ps)) for _, ps in sorted(by_length.items())]

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        return itertools.chain.from_iterable(g.find(text) for g in self.groups)


def save_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> list[str]:
    """The benchmark's windows as table blocks in the shared folder; returns their paths.

    Items are dealt to blocks by Spark; a block is written by the task that holds it.
    """
    spark = benchmark.sparkSession
    asked = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    folder = common.scratch(spark, "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(set(windows_of(words_of(t), size)))
                for i in range(0, len(found), 4096):
                    part = found[i : i + 4096]
                    names = pa.array(["null" if name is None else name] * len(part), pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(part, pa.binary())], ["item", "window"])

    rows = common.stored(asked.mapInArrow(cut, "item string, window binary").distinct())
    blocks = max(1, -(-rows.count() // BLOCK_WINDOWS))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, windows, part = [], [], 0
        from pyspark import TaskContext

        def flush():
            path = f"{folder}/{TaskContext.get().partitionId()}-{part}-{TaskContext.get().taskAttemptId()}.npz"
            ends = np.cumsum([len(w) for w in windows], dtype=np.int64)
            texts = np.frombuffer(b"".join(windows), np.uint8)
            return common.save_arrays(path, texts=texts, ends=ends, items=np.array(names, dtype=np.str_))

        paths = []
        for batch in batches:
            names += batch.column(0).to_pylist()
            windows += batch.column(1).to_pylist()
            while len(names) >= 2 * BLOCK_WINDOWS:
                rest = names[BLOCK_WINDOWS:], windows[BLOCK_WINDOWS:]
                names, windows = names[:BLOCK_WINDOWS], windows[:BLOCK_WINDOWS]
                paths.append(flush())
                (names, windows), part = rest, part + 1
        if names:
            paths.append(flush())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    spread_out = rows.repartition(blocks, F.xxhash64("window"))
    # One path for each block of windows: the list is as long as the benchmark has blocks.
    return sorted(r.path for r in common.stored(spread_out.mapInArrow(save, "path string")).collect())


def load_patterns(path: str) -> Patterns:
    got = common.load_arrays(path)
    raw, ends = got["texts"].tobytes(), got["ends"].tolist()
    starts = [0, *ends[:-1]]
    return Patterns([(raw[a:b], str(n)) for a, b, n in zip(starts, ends, got["items"].tolist(), strict=True)])


class Searcher:
    """Looks a batch of texts up in every table block, one block in memory at a time."""

    def __init__(self, paths: list[str]):
        self.paths = paths
        self.only = load_patterns(paths[0]) if len(paths) == 1 else None

    def marks(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its words, the word ranges hit, the items found."""
        words = [words_of(t) for t in texts]
        joined = [b" %s " % b" ".join(w) for w in words]
        starts = np.cumsum([0, *(len(j) + 1 for j in joined)])
        whole = b"\n".join(joined)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for path in self.paths:
            patterns = self.only or load_patterns(path)
            found = list(patterns.find(whole))
            docs = np.searchsorted(starts, [p for p, _ in found], side="right") - 1
            spaces: dict[int, np.ndarray] = {}
            for (p, window), d in zip(found, docs.tolist(), strict=True):
                if d not in spaces:
                    spaces[d] = np.flatnonzero(np.frombuffer(joined[d], np.uint8) == 32)
                first = int(np.searchsorted(spaces[d], p - starts[d]))
                hits[d].append((first, first + window.count(b" ") - 1))
                items[d] |= patterns.items[window]
        return [(len(w), hits.get(i, []), items.get(i, set())) for i, w in enumerate(words)]


def covered(ranges: list[tuple[int, int]]) -> int:
    """Words in the union of half-open ranges."""
    total, upto = 0, 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


MARKS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _marked(columns: list[str], paths: list[str], text: int):
    """Arrow function: the first columns, and the marks of the text in column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(paths)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and (not part or size < CHUNK):
                    part.append(batch.column(text)[at + len(part)].as_py())
                    size += len(part[-1] or "")
                rows = searcher.marks(part)
                hit = [covered(r[1]) for r in rows]
                names = [",".join(sorted(r[2])).encode() for r in rows]
                arrays = [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in names], pa.string()),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                ]
                kept = [batch.column(i).slice(at, len(part)) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *arrays],
                    [*columns, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )
                at += len(part)

    return run


def mark(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    size: int = WINDOW,
) -> DataFrame:
    """Per document: its words, the words inside occurring windows, the items found."""
    paths = save_windows(benchmark, item, "text", size)
    kind = documents.schema[id_column].dataType.simpleString()
    asked = documents.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    return asked.mapInArrow(_marked([id_column], paths, 1), f"`{id_column}` {kind}, {MARKS}")


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents without any test string, with all their columns."""
    paths = save_windows(benchmark, "item_id", "text", size)
    inner = [f"_c{i}" for i in range(len(documents.columns))]
    kinds = ", ".join(
        f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, documents.schema.fields, strict=True)
    )
    place = documents.columns.index(text)
    marked = documents.toDF(*inner).mapInArrow(_marked(inner, paths, place), f"{kinds}, {MARKS}")
    return marked.where("not contaminated").select(*inner).toDF(*documents.columns)


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return mark(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))


# The same rows by joining positions; the words of a text stand one space apart.
OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
found AS (SELECT pos.doc_id, pos.i, pos.k, win.item_id FROM pos JOIN win USING (k, s)),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM found) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit,
  coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
