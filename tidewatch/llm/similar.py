"""Similarity join of shingle sets by a size-aware light-heavy split, and its components.

Two sets link when 100 * intersection >= t * union, t = ``PERCENT`` unless said otherwise. With sizes n <= m that
means an overlap of at least c(n, m) = ceil(t (n + m) / (100 + t)) and at most (100 - t) (n + m) / (100 + t) elements
in one set only.

* Light sets list all their subsets of each size c that a partner of fitting size asks for: two of
  them link exactly when they share a subset of their c.
* Heavy sets go into inverted lists of single shingles, but only of those that a link can't do without. Shingles are
  ordered by how many texts hold them, the rarest first, then by hash. Linked sets share one of the first
  n - ceil(t n / 100) + 1 of each (``prefix``), so a set stands in the lists of these only; and a shingle that no other text holds
  has no list. A passage that many texts share stands last in the order: it is listed for those sets only that consist of such passages.
* The boundary is the last size at which listing subsets costs no more than counting the shingles and listing the prefix.

How many texts hold a shingle is counted without a row for each: a stretch of texts (``SPAN``) sends one sorted array of 32-bit
hashes to each range of hashes, the range counts them, and the counts come back as one byte per hash, in a file
of the shared folder for each stretch. (Hashes of a range that collide count together, which changes the order for all sets alike
and can only keep more lists.) Texts are first written as a table, so that the stretches are the same both times; a hash sum
is compared to be sure.

Equal sets are one node. Lists are scanned three times. First each set is verified, on the full texts, against
the head that it shares most lists with, and links make components. Then every list that still holds
two components is scanned whole, twice: members carry the counts of their shingles in ``BUCKETS`` hash
buckets, and the sum of the differences of two sets' counts is at most the number of shingles that one
of them lacks. The first of these scans passes on a forest per list, the closest pairs
that would connect its components; they are verified on the texts and mostly link. The second passes on every pair that the
bound still allows between components. So every pair of a list is connected, ruled out exactly, or verified: no link between
different sets is lost, and links inside what is connected already are not passed on. Lists of over ``BLOCK`` members are cut into
blocks, and pairs of blocks go to different tasks.

Words are lower-case A-Z, cut at white space; a set holds the distinct shingles of ``WORDS`` words
unless said otherwise, or the whole sequence where there are fewer words. Null or wordless texts have an empty set, link with
nothing and are their own component. A null id counts as no id: its component has the smallest other
id, or null. Repeated rows are copies. Other columns are carried by ``near_duplicates``.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.suffixes import Hasher, mixed
from tidewatch.operators import spread

# What links unless said otherwise: shingles of so many words, and so many hundredths of the union.
WORDS, PERCENT = 3, 90
BUCKETS = 256
BLOCK = 1500
# Text whose sets are made at once.
CHUNK = 1 << 20
# Text whose shingles are counted together, and ranges of hashes for each task that counts.
SPAN, RANGES = 4 << 20, 4

FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
U = np.uint64


def overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """The least intersection of linked sets of n and m elements."""
    return -(-percent * (n + m) // (100 + percent))


def apart(total, percent: int = PERCENT):
    """The most elements in one set only, of linked sets with ``total`` elements together."""
    return (100 - percent) * total // (100 + percent)


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """Subset sizes that a set of n elements lists: one for each size of a partner."""
    return sorted({overlap(n, m, percent) for m in range(-(-percent * n // 100), 100 * n // percent + 1)})


def prefix(n, percent: int = PERCENT):
    """Shingles of a set of n that its links can't all avoid: a linked set holds ceil(percent n / 100) of the n."""
    return n + 1 + (-percent * n // 100)


@lru_cache
def boundary(percent: int = PERCENT) -> int:
    """The largest size of a light set: up to it subsets are no more than shingles to count and to list."""
    n = 1
    while sum(math.comb(n + 1, c) for c in subset_sizes(n + 1, percent)) <= n + 1 + prefix(n + 1, percent):
        n += 1
    return n


class Sets:
    """The shingle sets of a chunk of texts: for each distinct shingle its document and hash."""

    def __init__(self, hasher: Hasher, texts: list[bytes], shingle: int = WORDS):
        raw = b" ".join(t.translate(FOLD) for t in texts) + b" "
        data = np.frombuffer(raw, np.uint8)
        space = np.concatenate([[True], data == 32])
        start = np.flatnonzero(space[:-1] & ~space[1:])
        end = np.flatnonzero(space[1:] & ~space[:-1])
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, start, side="right")
        word = mixed(hasher.of(hasher.sums(data), start, end) + (end - start).astype(U))
        words = np.bincount(doc, minlength=len(texts))
        k = np.arange(len(doc)) - np.repeat(np.cumsum(words) - words, words)
        value, odd = word.copy(), U(0xD6E8FEB86659FD93)
        width = np.minimum(words, shingle)[doc]
        for i in range(1, shingle):
            on = np.flatnonzero(width > i)
            on = on[on + i < len(word)]
            value[on] = mixed(value[on] * odd + word[on + i])
        full = k <= words[doc] - width
        value, doc = mixed(value[full] + width[full].astype(U)), doc[full]
        key = mixed(value + doc.astype(U) * U(0x9E3779B97F4A7C15))
        first = np.unique(key, return_index=True)[1]
        order = first[np.argsort(doc[first], kind="stable")]
        self.doc, self.value = doc[order], value[order]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.s1, self.s2 = np.zeros(len(texts), U), np.zeros(len(texts), U)
        np.add.at(self.s1, self.doc, mixed(self.value ^ U(0xA5A5A5A5A5A5A5A5)))
        np.add.at(self.s2, self.doc, mixed(self.value ^ U(0x3C3C3C3C3C3C3C3C)))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        return self.s1.view(np.int64), (self.s2 >> U(32)).astype(np.uint32).view(np.int32)

    def subsets(self, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """(document, key) of the subsets that the light sets list."""
        docs, keys = [], []
        start = np.cumsum(self.size) - self.size
        for d in np.flatnonzero((self.size > 0) & (self.size <= boundary(percent))).tolist():
            mine = mixed(self.value[start[d] : start[d] + self.size[d]])
            total = mine.sum(dtype=U)
            for c in subset_sizes(len(mine), percent):
                left_out = list(itertools.combinations(range(len(mine)), len(mine) - c))
                out = np.array(left_out, np.int64).reshape(len(left_out), -1)
                sums = np.full(len(out), total) - mine[out].sum(axis=1, dtype=U)
                docs.append(np.full(len(sums), d))
                keys.append(mixed(sums + mixed(np.full(len(sums), c, U) << U(48))))
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(docs), np.concatenate(keys).view(np.int64)


class Stretch:
    """The sets of a stretch of texts, equal texts once, and the hashes of those shingles that may be listed."""

    def __init__(self, hasher: Hasher, texts: list[bytes], shingle: int, percent: int, ranges: int):
        unique = list(dict.fromkeys(texts))
        parts, docs, values, base, at = [], [], [], 0, 0
        while at < len(unique):
            upto, size = at, 0
            while upto < len(unique) and (upto == at or size < CHUNK):
                size += len(unique[upto])
                upto += 1
            sets = Sets(hasher, unique[at:upto], shingle)
            parts.append((base, sets))
            # A light set that may have heavy partners is listed in both ways.
            on = (100 * sets.size // percent > boundary(percent))[sets.doc]
            docs.append(sets.doc[on] + base)
            values.append(sets.value[on])
            base, at = base + upto - at, upto
        self.parts = parts
        self.size = np.concatenate([s.size for _, s in parts]) if parts else np.zeros(0, np.int64)
        self.s1, self.s2 = (np.concatenate(x) for x in zip(*(s.ids() for _, s in parts), strict=True)) if parts else ([], [])
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.value = np.concatenate(values) if values else np.zeros(0, U)
        # The upper half gives the range, the lower half the place in it.
        of = ((self.value >> U(32)) * U(ranges)) >> U(32)
        key = (of << U(32)) | (self.value & U(0xFFFFFFFF))
        self.order = np.argsort(key, kind="stable")
        self.sorted = key[self.order]
        self.check = zlib.crc32(self.sorted.tobytes())

    def prefixes(self, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, shingle) of every list of a prefix; ``counts`` belong to the sorted hashes."""
        held = np.empty(len(counts), np.uint8)
        held[self.order] = counts
        alone = held <= 1
        # The rarest come first: a set with enough shingles of its own stands in no list.
        left = prefix(self.size, percent) - np.bincount(self.doc[alone], minlength=len(self.size))
        on = np.flatnonzero(~alone & (left > 0)[self.doc])
        on = on[np.lexsort((self.value[on], held[on], self.doc[on]))]
        doc = self.doc[on]
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        place = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
        on = on[place < left[doc]]
        return self.doc[on], self.value[on].view(np.int64)

    def subsets(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        found = [(base, *sets.subsets(percent)) for base, sets in self.parts]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([d + b for b, d, _ in found]), np.concatenate([k for _, _, k in found])


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte: themselves below 128, then in steps of an eighth; larger counts never give less."""
    steps = 128 + np.floor(8 * (np.log2(np.maximum(counts, 128)) - 7)).astype(np.int64)
    return np.minimum(np.where(counts < 128, counts, steps), 255).astype(np.uint8)


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of stretches of a batch."""
    at = 0
    while at < batch.num_rows:
        texts, size = [], 0
        while at + len(texts) < batch.num_rows and (not texts or size < most):
            texts.append(batch.column(column)[at + len(texts)].as_py() or b"")
            size += len(texts[-1])
        yield at, texts
        at += len(texts)


def as_bytes(text: str):
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def set_ids(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """Per row: id, t1, t2 (hashes of its text), n, s1, s2 (hashes of its set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at, texts in chunks(batch, 3):
                sets = Sets(hasher, texts, shingle)
                s1, s2 = sets.ids()
                kept = [batch.column(i).slice(at, len(texts)) for i in range(3)]
                arrays = [*kept, pa.array(sets.size.astype(np.int64)), pa.array(s1), pa.array(s2)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "t1", "t2", "n", "s1", "s2"])

    kind = df.schema["id"].dataType.simpleString()
    asked = df.select("id", F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), as_bytes(text).alias("raw"))
    return asked.mapInArrow(run, f"id {kind}, t1 long, t2 int, n long, s1 long, s2 int")


def _stretches(batches: Iterator[pa.RecordBatch], *how) -> Iterator[tuple[str, Stretch]]:
    """(name, stretch) of a task's texts: the same each time that the same partition is read."""
    from pyspark import TaskContext

    hasher, task, number = Hasher(), TaskContext.get().partitionId(), 0
    for batch in batches:
        for _, texts in chunks(batch, 0, SPAN):
            yield f"{task}-{number}", Stretch(hasher, texts, *how)
            number += 1


def count_holders(raws: DataFrame, shingle: int, percent: int) -> tuple[str, int]:
    """How many texts hold each shingle, in a file for each stretch; the folder and the number of ranges."""
    spark = raws.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, folder = max(parts, min(RANGES * parts, 4096)), common.scratch(spark, "holders")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, stretch in _stretches(batches, shingle, percent, ranges):
            edges = np.searchsorted(stretch.sorted, np.arange(ranges + 1, dtype=U) << U(32))
            low = stretch.sorted.astype("<u4")
            on = np.flatnonzero(edges[1:] > edges[:-1])
            arrays = [
                pa.array(on, pa.int64()), pa.array([name] * len(on), pa.string()), pa.array([stretch.check] * len(on), pa.int64()),
                pa.array([low[edges[r] : edges[r + 1]].tobytes() for r in on.tolist()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "name", "sum", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            sent = [np.frombuffer(h[3], "<u4") for h in held]
            _, back, many = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
            answers = np.split(level(many)[back], np.cumsum([len(x) for x in sent])[:-1])
            columns = [[h[0] for h in held], [h[1] for h in held], [h[2] for h in held], [x.tobytes() for x in answers]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["part", "name", "sum", "data"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data, names = None, [], []

        def close() -> None:
            if last is not None:
                common.put(f"{folder}/{last[0]}", last[1].to_bytes(8, "little") + b"".join(data))
                names.append(last[0])

        for batch in batches:
            for _, name, check, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (name, check):
                    close()
                    last, data = (name, check), []
                data.append(part)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    fields = "part long, name string, sum long, data binary"
    sent = raws.mapInArrow(send, fields).repartition(parts, "part").sortWithinPartitions("part")
    back = sent.mapInArrow(count, fields).repartition(parts, "name").sortWithinPartitions("name", "part")
    common.stored(back.mapInArrow(save, "name string"))
    return folder, ranges


def listings(raws: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Every list that a set stands in: key, s1, s2; equal sets of a stretch once. ``raws`` is a stored table of texts."""
    folder, ranges = count_holders(raws, shingle, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, stretch in _stretches(batches, shingle, percent, ranges):
            counts = np.zeros(0, np.uint8)
            if len(stretch.sorted):
                raw = common.get(f"{folder}/{name}")
                counts = np.frombuffer(raw, np.uint8)[8:]
                if int.from_bytes(raw[:8], "little") != stretch.check or len(counts) != len(stretch.sorted):
                    raise RuntimeError("texts changed between two readings")
            for doc, key in (stretch.prefixes(counts, percent), stretch.subsets(percent)):
                for a in range(0, len(doc), 200_000):
                    d, k = doc[a : a + 200_000], key[a : a + 200_000]
                    arrays = [pa.array(k), pa.array(stretch.s1[d]), pa.array(stretch.s2[d])]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "s1", "s2"])

    return raws.mapInArrow(run, "key long, s1 long, s2 int")


def linked(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets link; ``texts`` has num, raw."""
    right = texts.select(F.col("num").alias("b"), F.col("raw").alias("raw_b"))
    left = texts.select(F.col("num").alias("a"), F.col("raw").alias("raw_a"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "raw_a", "raw_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last, mine = Hasher(), None, None
        for batch in batches:
            keep = []
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a != last:
                    last, mine = a, Sets(hasher, [batch.column(2)[i].as_py()], shingle).value
                other = Sets(hasher, [batch.column(3)[i].as_py()], shingle).value
                small, large = sorted((len(mine), len(other)))
                common_ = 0
                if 100 * small >= percent * large:
                    common_ = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * common_ >= percent * (small + large - common_))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """num, comp: the smallest num that is reachable. Least labels, with jumps along labels."""
    both = common.stored(edges.union(edges.select("b", "a")).distinct())
    labels = nodes.select("num", F.col("num").alias("comp"))
    while True:
        near = both.join(labels.withColumnRenamed("num", "a"), "a").groupBy("b").agg(F.min("comp").alias("near"))
        new = labels.join(near.withColumnRenamed("b", "num"), "num", "left")
        new = new.select("num", "comp", F.least("comp", F.coalesce("near", "comp")).alias("next"))
        # The label of the node that gives the new label is at most that label.
        jump = labels.select(F.col("num").alias("next"), F.col("comp").alias("far"))
        after = common.stored(new.join(jump, "next").select("num", "comp", "far"))
        changed = after.where("far != comp").limit(1).count()
        labels = after.select("num", F.col("far").alias("comp"))
        if not changed:
            return labels


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: what is connected already counts as one node."""
    a = comps.select(F.col("num").alias("a"), F.col("comp").alias("x"))
    b = comps.select(F.col("num").alias("b"), F.col("comp").alias("y"))
    edges = links.join(a, "a").join(b, "b").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = common.stored(edges.distinct())
    ends = edges.select(F.col("a").alias("num")).union(edges.select("b")).distinct()
    over = components(edges, ends).select(F.col("num").alias("comp"), F.col("comp").alias("new"))
    return common.stored(comps.join(over, "comp", "left").select("num", F.coalesce("new", "comp").alias("comp")))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per row, in place of the text: n_shingles, component_id, and t1, t2 (hashes of its text)."""
    ids = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    with spread.job(df.sparkSession) as keep, common.tidy(df.sparkSession):
        ids = common.stored(ids)
        rows = keep(set_ids(ids, "text", shingle))
        named = keep(component_ids(ids, rows, shingle, percent))
    out = rows.join(named, ["s1", "s2"], "left")
    alone = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), alone.alias("component_id"), "t1", "t2")


def component_ids(ids: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """s1, s2, component_id of every set, from texts (id, text) and their sets (``set_ids``)."""
    sets = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("id"), F.min(F.struct("t1", "t2")).alias("t"))
    sets = common.stored(sets.select("s1", "s2", "id", "t.*", F.monotonically_increasing_id().alias("num")))

    # Lists of at least two different sets, then their members.
    lists = common.stored(listings(ids.select(as_bytes("text").alias("raw")), shingle, percent).distinct())
    one = F.struct("s1", "s2")
    long = lists.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo != hi").select("key")
    members = lists.join(long, "key").join(sets.select("s1", "s2", "num"), ["s1", "s2"])
    members = common.stored(members.select("key", "num"))
    # Of lists with equal members, one: copies with small changes share most of their lists.
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), F.col("num"))).alias(c) for i, c in enumerate("xy")]
    same = members.groupBy("key").agg(F.count("*").alias("many"), *hashes)
    chosen = same.groupBy("many", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = common.stored(members.join(chosen, "key"))
    nodes = common.stored(members.select("num").distinct())
    some = sets.join(nodes, "num").select("t1", "t2", "num")
    texts = ids.select(F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), as_bytes("text").alias("raw"))
    texts = common.stored(texts.join(some, ["t1", "t2"]).select("num", "raw").dropDuplicates(["num"]))

    # First each member against the head of the list that it shares most lists with.
    heads = members.groupBy("key").agg(F.min("num").alias("head"))
    shared = members.join(heads, "key").where("num != head").groupBy("num", "head").count()
    best = shared.groupBy("num").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("a"))
    links = common.stored(linked(best.select("a", F.col("num").alias("b")), texts, shingle, percent))
    comps = components(links, nodes)

    sketched = common.stored(sketches(texts, shingle))
    for whole in (False, True):
        state = members.join(comps, "num")
        lists = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
        members = common.stored(state.join(lists.where("lo != hi").select("key", "size"), "key"))
        pairs = common.stored(possible(members, sketched, whole, percent).distinct())
        comps = merged(comps, common.stored(linked(pairs, texts, shingle, percent)))
        members = members.select("key", "num")

    smallest = sets.join(comps, "num").groupBy("comp").agg(F.min("id").alias("component_id"))
    named = sets.join(comps, "num", "left").join(smallest, "comp", "left")
    return named.select("s1", "s2", F.coalesce("component_id", "id").alias("component_id"))


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """num, n, sketch: the counts of a set's shingles per hash bucket, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at, raw in chunks(batch, 1):
                sets = Sets(hasher, raw, shingle)
                slot = sets.doc * BUCKETS + (mixed(sets.value) % U(BUCKETS)).astype(np.int64)
                counts = np.bincount(slot, minlength=len(raw) * BUCKETS).reshape(-1, BUCKETS)
                # Counts are cut at 255: that makes the bound smaller, never wrong.
                rows = [c.tobytes() for c in np.minimum(counts, 255).astype(np.uint8)]
                arrays = [batch.column(0).slice(at, len(raw)), pa.array(sets.size.astype(np.int64)), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["num", "n", "sketch"])

    return texts.select("num", "raw").mapInArrow(run, "num long, n long, sketch binary")


def close_pairs(
    n: np.ndarray, comp: np.ndarray, sketch: np.ndarray, side: np.ndarray, percent: int = PERCENT
) -> tuple[np.ndarray, ...]:
    """Pairs of members of different components that the bound allows to link, and the bound.

    ``side`` is 0 or 1 where two blocks meet, and 2 throughout where a block meets itself.
    """
    first, second, bound = [], [], []
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    other = sketch[right].astype(np.int16)
    for at in range(0, len(left), 16):
        i = left[at : at + 16]
        total = n[i][:, None] + n[right]
        ok = comp[i][:, None] != comp[right]
        ok &= 100 * np.minimum(n[i][:, None], n[right]) >= percent * np.maximum(n[i][:, None], n[right])
        if side[0] == 2:
            ok &= i[:, None] < right
        if not ok.any():
            continue
        differ = np.abs(sketch[i].astype(np.int16)[:, None, :] - other).sum(axis=2, dtype=np.int64)
        a, b = np.nonzero(ok & (differ <= apart(total, percent)))
        first.append(i[a])
        second.append(right[b])
        bound.append(differ[a, b])
    if not first:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return np.concatenate(first), np.concatenate(second), np.concatenate(bound)


def forest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that connect the components they join, the closest first (Boruvka)."""
    order = np.lexsort((j, i, apart))
    i, j = i[order], j[order]
    label, kept_i, kept_j = np.unique(comp, return_inverse=True)[1], [], []
    while True:
        on = label[i] != label[j]
        i, j = i[on], j[on]
        if not len(i):
            break
        best = np.full(label.max() + 1, len(i))
        at = np.arange(len(i))
        np.minimum.at(best, label[i], at)
        np.minimum.at(best, label[j], at)
        chosen = np.unique(best[best < len(i)])
        kept_i.append(i[chosen])
        kept_j.append(j[chosen])
        parent = list(range(len(best)))

        def root(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(label[i[chosen]].tolist(), label[j[chosen]].tolist(), strict=True):
            parent[root(x)] = root(y)
        label = np.array([root(x) for x in range(len(best))])[label]
    if not kept_i:
        return i, j
    return np.concatenate(kept_i), np.concatenate(kept_j)


def possible(state: DataFrame, sketched: DataFrame, whole: bool, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that a list holds and the bound does not rule out.

    Unless ``whole``, only as many for a list as would connect its components.
    """
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("num"), blocks).cast("int")
    dealt = state.select("key", "num", "comp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select(
        "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "num", "comp",
        F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"),
    ).join(sketched, "num")
    # Rows of a list meet in one task; the lists of a task come one after the other.
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("key", "lo", "hi", "num", "comp", "side", "n", "sketch")
    dealt = dealt.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def scan(num: np.ndarray, comp: np.ndarray, side: np.ndarray, n: np.ndarray, sketch: list[bytes]) -> pa.RecordBatch:
        counts = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, BUCKETS)
        i, j, differ = close_pairs(n, comp, counts, side, percent)
        if not whole:
            i, j = forest(i, j, differ, comp)
        a, b = np.minimum(num[i], num[j]), np.maximum(num[i], num[j])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            num, comp, side, n = (table.column(c).to_numpy() for c in ("num", "comp", "side", "n"))
            return scan(num, comp, side, n, table.column("sketch").to_pylist())

        last = None
        for batch in batches:
            ids = [np.asarray(batch.column(c)) for c in range(3)]
            change = np.zeros(batch.num_rows, bool)
            for c in ids:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key = tuple(int(c[a]) for c in ids)
                if held and key != last:
                    yield flush()
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield flush()

    return dealt.mapInArrow(run, "a long, b long")


def keep_one(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row of each component, that with the smallest id, with all columns; wordless texts stay.

    Rows of a component that have its id but different texts are told apart by the texts' hashes.
    """
    found = near_duplicates(df, doc_id, text, shingle, percent)
    first = F.min(F.struct(F.col(doc_id).isNull(), doc_id, "t1", "t2")).alias("first")
    groups = found.where("n_shingles > 0").select(doc_id, "component_id", "t1", "t2")
    chosen = groups.groupBy("component_id").agg(first)
    plain = found.where("n_shingles = 0").select(doc_id, "t1", "t2")
    chosen = chosen.select("first.*").select(doc_id, "t1", "t2").union(plain).distinct()
    keyed = df.withColumns({"_t1": F.xxhash64(F.col(text).cast("string")), "_t2": F.hash(F.col(text).cast("string"))})
    chosen = common.stored(chosen.toDF("_id", "_t1", "_t2"))
    same = keyed[doc_id].eqNullSafe(chosen["_id"]) & (keyed["_t1"] == chosen["_t1"]) & (keyed["_t2"] == chosen["_t2"])
    kept = keyed.join(chosen, same, "left_semi")
    # Rows that repeat an id and text are rare: only if there are any, all texts are compared.
    twice = found.join(chosen.toDF(doc_id, "t1", "t2"), [doc_id, "t1", "t2"], "left_semi").where("n_shingles > 0")
    if twice.groupBy(doc_id, "t1", "t2").count().where("count > 1").limit(1).count():
        blank = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", F.monotonically_increasing_id())
        kept = kept.withColumn("_blank", blank).dropDuplicates([doc_id, "_t1", "_t2", "_blank"])
    return kept.select(*df.columns)


def op8_similar(spark: SparkSession, folder: str) -> DataFrame:
    documents = common.table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(documents, shingle=WORDS, percent=PERCENT).drop("t1", "t2")
