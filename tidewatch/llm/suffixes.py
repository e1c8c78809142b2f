"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Every string of ``length`` bytes holds exactly one anchor: the place of its least hashed
``PREFIX``-byte string, the first of equals. Equal strings have their anchor at the same place, so only
suffixes that start at anchors need to be indexed (about one in 60). The stretch of strings that share
an anchor is its context; equal contexts have equal fingerprints.

A level of the index is a suffix array of contexts: a bucketed table, each bucket in order of the suffixes'
first 8 bytes and then of the fingerprint of their first 64, so that suffixes that agree in 64 bytes are
neighbours. Equal contexts are one row with a count, which is why a text or passage that a third
of the rows share stays small. A new batch of documents becomes an array of its own, is merge-scanned
against every level for shared suffixes (joins of equally bucketed tables: nothing is shuffled), and
then levels of equal rank merge, as the digits of a binary counter carry, so that each row is
rewritten log2(batches) times at most.

A context that occurs twice makes all its bytes repeats. A context that occurs once but shares its
anchor string with others is compared string by string (64-bit hashes of all its strings, under the
anchor's own 64 bits); runs with very many contexts are split by those hashes. Texts are
shuffled once, to meet the places found in them.

Null and empty texts have no bytes and lose none. Rows are told apart by a 96-bit hash of id and
text: repeated rows repeat each other and lose the same bytes; null ids are ids. All other columns are
carried along. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.operators import spread

LENGTH = 200
PREFIX = 64
BATCHES = 4
# Text hashed at once; positions in it take 22 bits.
CHUNK = 1 << 20
# Contexts a task adds up before it passes them on.
HELD = 500_000
# Contexts of one run that a task compares, strings it holds before it compares them.
RUN, STRINGS = 1_000, 1_000_000

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def byte_values() -> np.ndarray:
    """A fixed odd 64-bit number for each byte."""
    found = [hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)]
    return np.array([int.from_bytes(x, "big") | 1 for x in found], np.uint64)


class Hasher:
    """Hashes of any stretches of a text, from sums of bytes weighted by powers of a base."""

    def __init__(self):
        self.values = byte_values()
        self.powers = self.inverse = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.powers) < n:
            size = max(n, CHUNK // 4)
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps, dtype=np.uint64)
            steps = np.full(size, INVERSE, np.uint64)
            steps[0] = 1
            self.inverse = np.cumprod(steps, dtype=np.uint64)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.values[data] * self.powers[: n - 1], dtype=np.uint64, out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverse[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Anchors:
    """Anchors of a piece of text: their place, first and last string, suffix keys, fingerprints."""

    def __init__(self, length: int):
        self.length, self.prefix = length, min(PREFIX, max(8, length // 3))
        self.hasher = Hasher()

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(lo, hi, at, head, h, fp) of all anchors in texts that end at ``ends`` of ``data``."""
        size, k = self.length, self.prefix
        starts = np.concatenate([[0], ends[:-1]])
        places = np.repeat(np.maximum(ends - size + 1, starts), ends - starts)
        first = np.arange(len(data))
        ok = first < places
        if len(data) < size or not ok.any():
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        sums = self.hasher.sums(data)
        grams = np.arange(len(data) - k + 1)
        h = mixed((sums[k:] - sums[:-k]) * self.hasher.inverse[grams])
        least = (h >> np.uint64(22) << np.uint64(22)) | grams.astype(np.uint64)
        width, step = size - k + 1, 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        first = np.flatnonzero(ok[: len(least)])
        at = (least[first] & np.uint64((1 << 22) - 1)).astype(np.int64)
        # A run of strings with one anchor in one text is a context.
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)])
        lo, at = first[new], at[new]
        hi = first[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(first) - 1]])]
        print_ = self.hasher.of(sums, lo, hi + size) + mixed((at - lo).astype(np.uint64) + np.uint64(BASE))
        head = np.zeros(len(at), np.uint64)
        for i in range(8):
            head = head << np.uint64(8) | data[at + i].astype(np.uint64)
        head ^= np.uint64(1 << 63)  # signed order is the order of the bytes
        return lo, hi, at, head.view(np.int64), h[at].view(np.int64), mixed(print_).view(np.int64)


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Texts in chunks: [(row, offset)], data, ends. A longer text is cut so that each string is in one piece."""
    step = CHUNK - length + 1
    held, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for offset in range(0, max(len(text) - length + 1, 0), step):
            part = text[offset : offset + CHUNK]
            if size + len(part) > CHUNK and parts:
                yield held, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                held, parts, size = [], [], 0
            held.append((row, offset))
            parts.append(part)
            size += len(part)
    if parts:
        yield held, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def located(anchors: Anchors, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, lo, hi - lo, at - lo, head, h, fp) of all anchors, places counted in the row's text."""
    for held, data, ends in pieces(texts, anchors.length):
        lo, hi, at, *keys = anchors.find(data, ends)
        part = np.searchsorted(ends, lo, side="right")
        rows, offsets = np.array([r for r, _ in held]), np.array([o for _, o in held])
        shift = offsets[part] - np.concatenate([[0], ends[:-1]])[part]
        yield rows[part], lo + shift, hi - lo, at - lo, *keys


def with_key(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Columns r1, r2: a 96-bit hash of id and text; raw: the text's bytes."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return df.select("*", F.xxhash64(doc_id, text).alias("r1"), F.hash(text, doc_id).alias("r2"), raw.alias("raw"))


PLACE = "head long, h long, fp long, n long, r1 long, r2 int, lo long"


def contexts(keyed: DataFrame, length: int) -> DataFrame:
    """Anchor contexts of (r1, r2, raw), added up per task: ``PLACE``, the place being of one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, waiting, held = Anchors(length), [], 0
        for batch in batches:
            r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(2).slice(at, 256).to_pylist()
                for row, lo, _, _, head, h, fp in located(anchors, texts):
                    waiting.append((head, h, fp, r1[at + row], r2[at + row], lo))
                    held += len(lo)
                if held >= HELD:
                    yield summed(waiting)
                    waiting, held = [], 0
        if waiting:
            yield summed(waiting)

    def summed(waiting: list[tuple]) -> pa.RecordBatch:
        head, h, fp, r1, r2, lo = (np.concatenate(c) for c in zip(*waiting, strict=True))
        order = np.lexsort((fp, h))
        h, fp = h[order], fp[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])])[: len(h)])
        n = np.diff(np.append(new, len(h)))
        pick = order[new]
        arrays = [head[pick], h[new], fp[new], n.astype(np.int64), r1[pick], r2[pick], lo[pick]]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], [c.split()[0] for c in PLACE.split(", ")])

    return keyed.select("r1", "r2", "raw").where(F.octet_length("raw") >= length).mapInArrow(run, PLACE)


class SuffixIndex:
    """Levels of suffix arrays, and the suffixes that any two batches (or one) share."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = common.scratch(spark, "suffixes")
        self.name = f"tidewatch_suffixes_{uuid.uuid4().hex}"
        self.levels: list[tuple[int, str]] = []
        self.made = 0
        self.shared: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> str:
        """Equal contexts become one row, rows go to their bucket in suffix order."""
        self.made += 1
        name = f"{self.name}_{self.made}"
        one = F.min(F.struct("r1", "r2", "lo")).alias("one")
        dealt = rows.repartition(self.buckets, "head", "h").groupBy("head", "h", "fp")
        summed = dealt.agg(F.sum("n").alias("n"), one).select("head", "h", "fp", "n", "one.*")
        with common.tidy(self.spark):
            writer = summed.write.bucketBy(self.buckets, "head", "h").sortBy("head", "h")
            writer.option("path", f"{self.path}/{self.made}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        spread.remove(self.spark, f"{self.path}/{name.rsplit('_', 1)[1]}")

    def add(self, batch: DataFrame) -> None:
        """Sort a batch's suffixes, scan it against all levels, then merge levels of equal rank."""
        name, rank = self._write(batch), 0
        new = self.spark.table(name)
        own = new.groupBy("head", "h").agg((F.sum("n") > 1).alias("twice"))
        found = own.where("twice").select("head", "h")
        for _, level in self.levels:
            found = found.union(own.select("head", "h").join(self.spark.table(level), ["head", "h"], "left_semi"))
        # One file for each bucket, not for each bucket and level.
        self.shared.append(common.stored(found.coalesce(self.buckets)))
        merged = [name]
        while self.levels and self.levels[-1][0] == rank:
            merged.append(self.levels.pop()[1])
            rank += 1
        if len(merged) > 1:
            # All levels that a carry takes along are written once.
            rows = new
            for other in merged[1:]:
                rows = rows.union(self.spark.table(other))
            name = self._write(rows)
            for other in merged:
                self._drop(other)
        self.levels.append((rank, name))

    def matches(self) -> DataFrame:
        """Contexts whose suffix was found twice: h, fp, n, run (contexts of the suffix), a place."""
        rows = self.spark.table(self.levels[0][1])
        for _, level in self.levels[1:]:
            rows = rows.union(self.spark.table(level))
        keys = self.shared[0]
        for more in self.shared[1:]:
            keys = keys.union(more)
        rows = rows.join(keys.distinct(), ["head", "h"], "left_semi")
        one = F.min(F.struct("r1", "r2", "lo")).alias("one")
        rows = rows.groupBy("head", "h", "fp").agg(F.sum("n").alias("n"), one)
        runs = rows.groupBy("head", "h").agg(F.count("*").alias("run"))
        return rows.join(runs, ["head", "h"]).select("h", "fp", "n", "run", "one.*")

    def drop(self) -> None:
        for _, name in self.levels:
            self._drop(name)
        self.levels = []
        spread.remove(self.spark, self.path)


def occurrences(keyed: DataFrame, length: int) -> DataFrame:
    """Every anchor of every row: h, fp, r1, r2, lo, extra (strings of the context but one)."""
    names = ["h", "fp", "r1", "r2", "lo", "extra"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(2).slice(at, 256).to_pylist()
                for row, lo, extra, _, _, h, fp in located(anchors, texts):
                    arrays = [h, fp, r1[at + row], r2[at + row], lo, extra.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)

    asked = keyed.select("r1", "r2", "raw").where(F.octet_length("raw") >= length)
    return asked.mapInArrow(run, "h long, fp long, r1 long, r2 int, lo long, extra int")


def strings(table: DataFrame, length: int) -> DataFrame:
    """Hashes of the strings of all contexts to be compared: h, part, r1, r2, lo, ask, which, hashes."""
    names = ["h", "part", "r1", "r2", "lo", "ask", "which", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for i in range(batch.num_rows):
                raw, out = np.frombuffer(batch.column(2)[i].as_py(), np.uint8), []
                r1, r2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for c in batch.column(3)[i].as_py():
                    sums = hasher.sums(raw[c["lo"] : c["lo"] + c["extra"] + length])
                    first = np.arange(c["extra"] + 1)
                    hashes = mixed(hasher.of(sums, first, first + length))
                    parts = -(-c["run"] // RUN)
                    part = (hashes % np.uint64(parts)).astype(np.int64)
                    for p in np.unique(part).tolist():
                        w = np.flatnonzero(part == p)
                        which, picked = w.astype(np.uint8).tobytes(), hashes[w].tobytes()
                        out.append((c["h"], p, r1, r2, c["lo"], c["n"] == 1, which, picked))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else []
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "h long, part long, r1 long, r2 int, lo long, ask boolean, which binary, hashes binary"
    asked = table.where(F.size("compare") > 0).select("r1", "r2", "raw", "compare")
    return asked.mapInArrow(run, schema)


def repeated_strings(hashed: DataFrame, length: int) -> DataFrame:
    """Byte ranges of the strings that two contexts of a run share: r1, r2, a, b."""
    parts = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = hashed.repartition(parts, "h", "part").sortWithinPartitions("h", "part")
    names = ["r1", "r2", "a", "b"]

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        key = np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1, 2)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.array([len(r[6]) for r in rows])
        hashes = np.frombuffer(b"".join(r[7] for r in rows), np.uint64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        which = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).astype(np.int64)
        order = np.lexsort((hashes, group[owner]))
        g, v = group[owner][order], hashes[order]
        same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
        twice = np.zeros(len(order), bool)
        twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        twice &= np.array([r[5] for r in rows])[owner]
        owner, which = owner[twice], which[twice]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (which[1:] != which[:-1] + 1)])[: len(owner)])
        last = np.concatenate([new[1:] - 1, [len(owner) - 1]])[: len(new)]
        r1, r2, lo = (np.array([r[i] for r in rows], np.int64)[owner[new]] for i in (2, 3, 4))
        arrays = [r1, r2.astype(np.int32), lo + which[new], lo + which[last] + length]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if held >= STRINGS and row[:2] != last:
                    yield compared(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[6])
                last = row[:2]
        if rows:
            yield compared(rows)

    return dealt.mapInArrow(run, "r1 long, r2 int, a long, b long")


def union_of(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by half-open ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to the limits of UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def cut_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, batches: int = BATCHES,
    characters: bool = False, kept: bool = True,
) -> DataFrame:
    """df with n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (bytes); without the text.

    ``characters`` removes whole characters only.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c != text]
    inner = [f"_c{i}" for i in range(len(rest))]
    named = df.select(*[F.col(c).alias(n) for c, n in zip(rest, inner, strict=True)], F.col(text).alias("_text"))
    keyed = with_key(named.withColumn("_id", F.col(inner[rest.index(doc_id)])), "_id", "_text").drop("_id", "_text")

    index = SuffixIndex(spark)
    for i in range(batches):
        index.add(contexts(keyed.where(F.pmod(F.col("r1"), F.lit(batches)) == i), length))
    found = common.stored(index.matches().where("n > 1 or run > 1"))
    index.drop()

    # A context is removed whole, or compared if it is alone but has neighbours, or lends its strings.
    mark = found.withColumnRenamed("r1", "o1").withColumnRenamed("r2", "o2").withColumnRenamed("lo", "olo")
    places = occurrences(keyed, length).join(mark, ["h", "fp"])
    is_one = (F.col("r1") == F.col("o1")) & (F.col("r2") == F.col("o2")) & (F.col("lo") == F.col("olo"))
    whole = F.when(F.col("n") > 1, F.struct(F.col("lo").alias("a"), (F.col("lo") + F.col("extra") + length).alias("b")))
    ask = F.when((F.col("run") > 1) & ((F.col("n") == 1) | is_one), F.struct("h", "lo", "extra", "run", "n"))
    lists = places.groupBy("r1", "r2").agg(F.collect_list(whole).alias("whole"), F.collect_set(ask).alias("compare"))

    # Texts meet their places once; texts without any are done.
    parts = index.buckets
    table = keyed.join(lists, ["r1", "r2"], "left").withColumns(
        {
            "n_bytes": F.octet_length("raw").cast("long"),
            "digest": F.when(F.col("whole").isNull(), F.sha2("raw", 256)),
            "raw": F.when(F.col("whole").isNotNull() | F.lit(kept), F.col("raw")),
        }
    )
    name = f"{index.name}_texts"
    with common.tidy(spark):
        writer = table.repartition(parts, "r1", "r2").write.bucketBy(parts, "r1", "r2").sortBy("r1", "r2")
        writer.option("compression", "zstd").option("path", f"{index.path}/texts").saveAsTable(name)
    texts = spark.table(name)

    one = repeated_strings(strings(texts, length), length)
    some = one.groupBy("r1", "r2").agg(F.collect_list(F.struct("a", "b")).alias("part"))
    both = texts.join(some, ["r1", "r2"], "left")
    fields = [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(inner, rest, strict=True)]
    added = ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", *["kept binary"] * kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(inner)
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(start, 256)
                rows = []
                for i in range(batch.num_rows):
                    raw, full, part, size, digest = (batch.column(width + j)[i].as_py() for j in range(5))
                    spans = union_of([(s["a"], s["b"]) for s in [*(full or []), *(part or [])]])
                    if characters:
                        spans = whole_characters(raw, spans)
                    left = raw
                    if spans:
                        edges = [0, *(x for s in spans for x in s), size]
                        left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    if digest is None:
                        digest = hashlib.sha256(left).hexdigest()
                    rows.append((size, sum(b - a for a, b in spans), len(spans), digest, left)[: 4 + kept])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + kept]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                columns = [batch.column(i) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*columns, *arrays], [*inner, *(a.split()[0] for a in added)])

    asked = both.select(*inner, "raw", "whole", "part", "n_bytes", "digest")
    return asked.mapInArrow(run, ", ".join(fields + added)).toDF(*rest, *(a.split()[0] for a in added))


def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    documents = common.table(spark, folder, "documents").select("doc_id", "text")
    return cut_repeats(documents, kept=False)
