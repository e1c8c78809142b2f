"""Language-model scores from a class bigram model with classes found by exchange clustering.

P(word | previous word) = P(class | previous class) * P(word | class).

The ``ITEMS`` most frequent training words are items of their own, the end of a text is one more. Items are assigned
to classes by exchange: each in turn moves to the class that gains most likelihood of the
training bigrams, until no sweep gains. This is done twice. First any other word belongs to the item of its shape (a hash of its last
two bytes), and there are at most ``SEEDS`` classes. From these every other training word, however rare, gets an item by its own
bigrams: the class that comes most often before it and the one that comes most often after it (``rest``). All bigrams
are counted anew with these items, which the second exchange assigns to the classes of the model. Only a word that no training
text holds keeps the item of its shape, which goes to the class of most rare training words of that shape. Class transitions are
smoothed with class frequencies, emissions
by half a count for every known word of the class and one unknown word; both sum to one.

Texts are cut into words twice: to count the words, and to write each text as numbers (``coded``), a frequent word as its place
in the list and any other by its shape and 64-bit hash. Everything after reads the numbers, many texts at once.

Word counts and bigrams are taken over all training texts, added up per task before they are
shuffled. On the driver are the ``FREQUENT`` most frequent words, all of one count or none, and the
item bigrams (at most the square of the number of items). The items of the other words lie in files of the shared folder, one
for each range of their 64-bit hashes; a worker holds 10 bytes for each word in the ranges that it has met. Texts are scored in one
narrow pass over their numbers; the counts of words that are not frequent are joined, one row per text and
word, and added to the text's score.

Words are lower-case A-Z, cut at white space. Null and empty texts have the end as their only token. A null id
has the remainder of the empty text. Repeated rows are scored each, and learned from each. With
no training text every known count is 0. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

ITEMS = 1000
SHAPES = 128
CLASSES = 40
SWEEPS = 12
# Text whose words are looked up together, and texts whose numbers are.
TOGETHER, ROWS = 30_000, 512
# Classes of the first exchange.
SEEDS = 16
FREQUENT = 200_000
# Distinct words a task holds before it passes them on or forgets them.
HELD = 400_000
# Neighbours of rare words that a task counts at once, and bits of their hashes that give a range.
NEAR, RANGE_BITS = 2_000_000, 6
# Weight of the class frequencies in a transition.
WEIGHT = 5.0

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# The end of a text: no word has a space in it.
END = b" "


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts per task: w, c."""
    seen: Counter = Counter()
    for batch in batches:
        for value in batch.column(0):
            seen.update(words_of(value.as_py()))
            seen[END] += 1
            if len(seen) > HELD:
                yield _rows(seen)
                seen = Counter()
    yield _rows(seen)


def _rows(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "c"]
    )


def hashed(words: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    some = np.fromiter(words, object)
    return pd.util.hash_array(some, categorize=False) if len(some) else np.zeros(0, np.uint64)


def shape(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHAPES


class Words(list):
    """Words that are items of their own, and the files with the items of the other training words, by range of hashes."""

    def __init__(self, own: list[bytes], files: dict[int, str]):
        super().__init__(own)
        self.files = files

    def __reduce__(self):
        return Words, (list(self), self.files)


class Kept:
    """Items of the words beyond those that are items of their own, by hash; -1 for words that were not in training."""

    def __init__(self, files: dict[int, str]):
        # Ranges rise, and so do the hashes in each.
        kept = [common.load_arrays(files[part]) for part in sorted(files)]
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *(x["h"] for x in kept)])
        self.items = np.concatenate([np.zeros(0, np.uint16), *(x["item"] for x in kept)])

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hashes) or not len(keys):
            return np.full(len(keys), -1)
        # Neighbours in order are near each other in memory.
        some, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        return np.where(self.hashes[at] == some, self.items[at].astype(np.int64), -1)[back]


class Items(dict):
    """Word -> item: own words, shapes, the end, and those that other training words have from ``rest``."""

    def __init__(self, own: list[bytes]):
        super().__init__()
        self.own = {w: i for i, w in enumerate(own)}
        self.end = len(own) + SHAPES
        self.count = self.end + 1
        self.files = getattr(own, "files", {})
        self.kept: Kept | None = None

    def meet(self, words: list[bytes]) -> None:
        """Look up some words at once."""
        if len(self) >= HELD:
            self.clear()
        new = [w for w in set(words) if w not in self]
        found = np.full(len(new), -1)
        if self.files:
            self.kept = self.kept or Kept(self.files)
            found = self.kept.of(hashed(new))
        for word, item in zip(new, found.tolist(), strict=True):
            own = self.own.get(word)
            if own is None and word == END:
                own = self.end
            if own is None:
                # Words that were not in training have the item of their shape.
                own = self.count + item if item >= 0 else len(self.own) + shape(word)
            self[word] = own

    def __missing__(self, word: bytes) -> int:
        self.meet([word])
        return self[word]


@dataclass
class Vocabulary:
    """What the training texts count up to."""

    counts: DataFrame  # w, c of all words and the end
    frequent: dict[bytes, int]
    tokens: int
    types: int
    ends: int  # training texts

    @property
    def listed(self) -> list[bytes]:
        """The frequent words in the order of their numbers."""
        return [w for w in self.frequent if w != END]


def vocabulary(raw: DataFrame) -> Vocabulary:
    """Counts of the words of texts (raw)."""
    counted_ = raw.select("raw").mapInArrow(counted, "w binary, c long")
    counts = common.stored(counted_.groupBy("w").agg(F.sum("c").alias("c")))
    ends = F.sum(F.when(F.col("w") == F.lit(END), F.col("c")))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), ends.alias("ends")).first()
    frequent = dict(common.most_frequent(counts, FREQUENT))
    return Vocabulary(counts, frequent, int(total.n or 0), int(total.v), int(total.ends or 0))


CODED = (
    "id {}, held_out boolean, n_tokens long, known long, part double, row long, codes binary, hashes binary, "
    "rare array<binary>, times array<int>"
)


def coded(rows: DataFrame, frequent: dict[bytes, int], ends: int) -> DataFrame:
    """Rows (id, held_out, raw) with their texts as numbers, and what the frequent words add to their scores.

    ``codes`` has a 32-bit number for each word: its place among the frequent ones, or -1 less its shape. ``hashes`` are the 64-bit
    hashes of the latter, in order; ``rare`` are these words themselves, once each, with their ``times``.
    """
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "held_out", "n_tokens", "known", "part", "row", "codes", "hashes", "rare", "times"]
    pairs = [(w, c) for w, c in frequent.items() if w != END]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers, row = {w: i for i, (w, _) in enumerate(pairs)}, TaskContext.get().partitionId() << 40
        # Any negative number finds the last.
        logs = np.log10(np.array([*(c for _, c in pairs), 0.5]) + 0.5)
        end = float(np.log10(ends + 0.5))

        def numbered(texts: list[list[bytes]]) -> Iterator[tuple]:
            words = list(chain.from_iterable(texts))
            codes = np.fromiter(map(numbers.get, words, repeat(-1)), np.int32, len(words))
            value = logs[codes]
            new = np.flatnonzero(codes < 0)
            others = [words[i] for i in new.tolist()]
            codes[new] = -1 - np.fromiter(map(shape, others), np.int32, len(others))
            hashes = hashed(others)
            edges = np.cumsum([0, *map(len, texts)])
            inner = np.searchsorted(new, edges).tolist()
            for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                lo, hi = inner[i], inner[i + 1]
                rare = Counter(others[lo:hi])
                known = b - a - (hi - lo) + (ends > 0)
                yield (
                    b - a + 1, known, float(value[a:b].sum()) + end, codes[a:b].tobytes(), hashes[lo:hi].tobytes(),
                    list(rare), list(rare.values()),
                )

        types = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                out, texts, size = [], [], 0
                for value in batch.column(2):
                    raw = value.as_py() or b""
                    texts.append(words_of(raw))
                    size += len(raw)
                    if size >= TOGETHER:
                        out += numbered(texts)
                        texts, size = [], 0
                out += numbered(texts)
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)]
                arrays.insert(3, pa.array(np.arange(row, row + len(out))))
                row += len(out)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    return common.stored(rows.select("id", "held_out", "raw").mapInArrow(run, CODED.format(kind)))


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in binary values one after the other, and how many each value has."""
    offsets = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
    data, size = column.buffers()[2] if len(column) else None, np.dtype(kind).itemsize
    n = int(offsets[-1] - offsets[0]) // size
    return np.frombuffer(data, kind, n, int(offsets[0])) if n else np.zeros(0, kind), np.diff(offsets) // size


class Listed:
    """Hashes and shapes of the frequent words, in the order of their numbers."""

    def __init__(self, words: list[bytes]):
        self.hashes = hashed(words)
        self.shapes = np.fromiter(map(shape, words), np.int64, len(words))


class Lookup:
    """Items of coded texts. The first of the listed words are items of their own."""

    def __init__(self, listed: Listed, own: list[bytes]):
        n, files = len(own), getattr(own, "files", {})
        self.end = n + SHAPES
        self.kept = Kept(files) if files else None
        others = n + listed.shapes[n:]
        if self.kept:
            found = self.kept.of(listed.hashes[n:])
            others = np.where(found >= 0, self.end + 1 + found, others)
        # Codes below 0 find shapes from the end.
        self.table = np.concatenate([np.arange(n), others, np.arange(n + SHAPES - 1, n - 1, -1)])

    def texts(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of a batch that begins with codes and hashes: the slice, items, places of the words, codes, hashes.

        Items begin with the end, each text's words follow, and after each text an end.
        """
        for start in range(0, batch.num_rows, ROWS):
            some = batch.slice(start, ROWS)
            codes, sizes = flat(some.column(0), "<i4")
            hashes, _ = flat(some.column(1), "<u8")
            items = np.full(len(codes) + some.num_rows + 1, self.end)
            places = np.arange(len(codes)) + np.repeat(np.arange(1, some.num_rows + 1), sizes)
            found = self.table[codes]
            if self.kept:
                kept = self.kept.of(hashes)
                new = np.flatnonzero(codes < 0)[kept >= 0]
                found[new] = self.end + 1 + kept[kept >= 0]
            items[places] = found
            yield some, items, places, codes, hashes


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each item, from the counts of item bigrams; the last item keeps a class of its own."""
    n = len(pairs)
    classes = max(2, min(classes, n))
    totals = pairs.sum(axis=0)
    of = np.zeros(n, np.int64)
    order = np.lexsort((np.arange(n - 1), -totals[: n - 1]))
    of[order] = np.arange(n - 1) % (classes - 1)
    of[n - 1] = classes - 1

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    right, left = pairs @ member, pairs.T @ member  # counts of an item with each class
    joint = member.T @ right
    size_l, size_r = joint.sum(axis=1), joint.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for i in order:
            if not totals[i]:
                continue
            a, own = of[i], pairs[i, i]
            r, q = right[i], left[i]
            joint[a] -= r
            joint[:, a] -= q
            joint[a, a] += own
            size_l[a] -= r.sum()
            size_r[a] -= q.sum()
            # r and q count the item itself in its old class; it goes along to the new one.
            r2, q2 = r.copy(), q.copy()
            r2[a] -= own
            q2[a] -= own
            gain = (f(joint + r2) - f(joint)).sum(axis=1) + (f(joint + q2[:, None]) - f(joint)).sum(axis=0)
            d = np.arange(classes)
            diagonal = joint[d, d]
            gain -= f(diagonal + r2) + f(diagonal + q2) - 2 * f(diagonal)
            gain += f(diagonal + r2 + q2 + own) - f(diagonal)
            gain -= f(size_l + r.sum()) - f(size_l) + f(size_r + q.sum()) - f(size_r)
            gain[classes - 1] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += r2
            joint[:, b] += q2
            joint[b, b] += own
            size_l[b] += r.sum()
            size_r[b] += q.sum()
            if b != a:
                of[i] = b
                moved += 1
                right[:, a] -= pairs[:, i]
                right[:, b] += pairs[:, i]
                left[:, a] -= pairs[i]
                left[:, b] += pairs[i]
        if not moved:
            break
    return of


def _binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary value from each stretch of an array between two edges."""
    offsets = (edges * data.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def rest(texts: DataFrame, listed: Listed, own: list[bytes], of: np.ndarray, classes: int) -> Words:
    """Items of all training words that are none of their own, from their own bigrams, in files of the shared folder.

    A word's item tells the class (``of``, of its neighbours' items) that is most often before it, and that after it.
    """
    spark, folder, first = texts.sparkSession, common.scratch(texts.sparkSession, "classes"), len(own)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each word that is no item of its own: its hash, the classes around it, and how often each."""
        known, size = Lookup(listed, own), 0
        words, slots = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        # Frequent words are added up over the task.
        sums = np.zeros((len(listed.hashes) - first) * 2 * classes, np.uint32)

        def rows(hashes: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            """``keys`` rise: a word's place in ``hashes`` times 2 * classes, and a class."""
            edges = np.searchsorted(keys, np.arange(len(hashes) + 1) * 2 * classes)
            arrays = [
                pa.array((hashes >> np.uint64(64 - RANGE_BITS)).astype(np.int64)), pa.array(hashes.view(np.int64)),
                _binaries((keys % (2 * classes)).astype("<u2"), edges), _binaries(n.astype("<u4"), edges),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["part", "h", "near", "n"])

        def flush() -> pa.RecordBatch:
            some, back = np.unique(np.concatenate(words), return_inverse=True)
            keys, n = np.unique(back * 2 * classes + np.concatenate(slots), return_counts=True)
            return rows(some, keys, n)

        for batch in batches:
            for _, items, places, codes, hashes in known.texts(batch):
                kinds = of[items]
                before, after = kinds[places - 1], kinds[places + 1] + classes
                on = codes >= first
                cells = (codes[on].astype(np.int64) - first) * 2 * classes
                np.add.at(sums, cells + before[on], 1)
                np.add.at(sums, cells + after[on], 1)
                new = codes < 0
                words += [hashes, hashes]
                slots += [before[new], after[new]]
                size += 2 * len(hashes)
                if size >= NEAR:
                    yield flush()
                    words, slots, size = words[:1], slots[:1], 0
        yield flush()
        step = 20_000 * 2 * classes
        for start in range(0, len(sums), step):
            part = sums[start : start + step]
            met = np.flatnonzero(part.reshape(-1, 2 * classes).any(axis=1))
            chosen = part.reshape(-1, 2 * classes)[met].ravel()
            keys = np.flatnonzero(chosen)
            yield rows(listed.hashes[first + start // (2 * classes) + met], keys, chosen[keys])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum the counts of each word, rows of a word one after the other, and write each range's items."""
        part, hashes, chosen, names = None, [], [], []
        last, sums = np.zeros(0, np.int64), np.zeros((0, 2 * classes))

        def add(ids: np.ndarray, counts: np.ndarray) -> None:
            hashes.append(ids)
            chosen.append((counts[:, :classes].argmax(axis=1) * classes + counts[:, classes:].argmax(axis=1)).astype(np.uint16))

        def close() -> None:
            keys = np.concatenate(hashes).view(np.uint64)
            order = np.argsort(keys)
            common.save_arrays(f"{folder}/{part}", h=keys[order], item=np.concatenate(chosen)[order])
            names.append(part)

        for whole in batches:
            at, parts = 0, np.asarray(whole.column(0))
            while at < whole.num_rows:
                upto = min(at + 4096, int(np.searchsorted(parts, parts[at], side="right")))
                rows = whole.slice(at, upto - at)
                at = upto
                if part is not None and parts[at - 1] != part:
                    add(last, sums)
                    close()
                    hashes, chosen, last, sums = [], [], last[:0], sums[:0]
                part = int(parts[at - 1])
                ids, group = np.unique(np.asarray(rows.column(1)), return_inverse=True)
                codes, sizes = flat(rows.column(2), "<u2")
                n, _ = flat(rows.column(3), "<u4")
                slot = np.repeat(group, sizes) * 2 * classes + codes
                fresh = np.bincount(slot, n, minlength=len(ids) * 2 * classes).reshape(-1, 2 * classes)
                if len(last) and last[0] == ids[0]:
                    fresh[0] += sums[0]
                else:
                    add(last, sums)
                # The last word may go on in the next rows.
                add(ids[:-1], fresh[:-1])
                last, sums = ids[-1:], fresh[-1:]
        if part is not None:
            add(last, sums)
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64())], ["part"])

    sent = texts.select("codes", "hashes").mapInArrow(near, "part long, h long, near binary, n binary")
    parts = min(1 << RANGE_BITS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = common.stored(sent.repartition(parts, "part").sortWithinPartitions("part", "h").mapInArrow(choose, "part long"))
    return Words(own, {r.part: f"{folder}/{r.part}" for r in made.collect()})


@dataclass
class Model:
    own: list[bytes]
    frequent: dict[bytes, int]
    tokens: int
    types: int
    ends: int  # training texts
    of: np.ndarray
    transition: np.ndarray  # log10 P(class | class)
    room: np.ndarray  # log10 of each class's emission denominator

    @property
    def base_room(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.types + 1)))


def fit(train: DataFrame, text: str = "text", items: int = ITEMS, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model and the table of all training counts (w, c)."""
    raw = train.select(F.lit(0).alias("id"), F.lit(False).alias("held_out"), F.col(text).cast("binary").alias("raw"))
    words = vocabulary(raw)
    return learn(coded(raw, words.frequent, words.ends), words, items, classes), words.counts


def learn(texts: DataFrame, vocabulary: Vocabulary, items: int = ITEMS, classes: int = CLASSES) -> Model:
    """The model of coded training texts."""
    counts, own, listed = vocabulary.counts, vocabulary.listed[:items], Listed(vocabulary.listed)

    def item_pairs(known_words: list[bytes], count: int) -> np.ndarray:
        """How often an item follows another."""

        def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, sums = Lookup(listed, known_words), np.zeros(count**2, np.int64)
            for batch in batches:
                for _, at, _, _, _ in known.texts(batch):
                    np.add.at(sums, at[:-1] * count + at[1:], 1)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["pair", "n"])

        pairs = texts.select("codes", "hashes").mapInArrow(bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        # At most the square of the number of items.
        matrix = np.zeros(count**2)
        with common.tidy(texts.sparkSession):
            found = pairs.toPandas()
        matrix[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy()
        return matrix.reshape(count, count)

    known = Items(own)
    first = exchange(item_pairs(own, known.count), min(classes, SEEDS), SWEEPS)
    seeds = int(first.max()) + 1
    words = rest(texts, listed, own, first, seeds)
    matrix = item_pairs(words, known.count + seeds**2)
    # The end goes last, where the exchange leaves it alone.
    order = np.append(np.delete(np.arange(len(matrix)), known.end), known.end)
    of = np.empty(len(matrix), np.int64)
    of[order] = exchange(matrix[np.ix_(order, order)], classes, SWEEPS)
    classes = int(of.max()) + 1
    shapes = np.arange(len(own), known.end)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens and types of each class, and of those types that are no items, by shape (the last of them: own items)."""
        known, plain = Items(words), Items(own)
        n, v = np.zeros((classes, SHAPES + 1), np.int64), np.zeros((classes, SHAPES + 1), np.int64)
        for batch in batches:
            found = batch.column(0).to_pylist()
            known.meet(found)
            plain.meet(found)
            at = of[np.array([known[w] for w in found], np.int64)]
            shape = np.array([plain[w] for w in found], np.int64) - len(own)
            shape[(shape < 0) | (shape >= SHAPES)] = SHAPES
            np.add.at(n, (at, shape), batch.column(1).to_numpy())
            np.add.at(v, (at, shape), 1)
        cells = [np.repeat(np.arange(classes), SHAPES + 1), np.tile(np.arange(SHAPES + 1), classes), n.ravel(), v.ravel()]
        some = cells[3] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in cells], ["k", "shape", "n", "v"])

    sums = counts.mapInArrow(kinds, "k long, shape long, n long, v long").groupBy("k", "shape")
    n, v = np.zeros((classes, SHAPES + 1)), np.zeros((classes, SHAPES + 1))
    for r in sums.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r.k, r["shape"]], v[r.k, r["shape"]] = r.n, r.v
    # Words that were not in training are likest to the rare ones of their shape, or to all rare ones.
    rare = v[:, :SHAPES]
    of[shapes] = np.where(rare.any(axis=0), rare.argmax(axis=0), rare.sum(axis=1).argmax())
    n, v = n.sum(axis=1), v.sum(axis=1)
    member = np.zeros((len(of), classes))
    member[np.arange(len(of)), of] = 1
    joint = member.T @ matrix @ member
    share = (n + 0.5) / (n.sum() + 0.5 * classes)
    transition = np.log10((joint + WEIGHT * share) / (joint.sum(axis=1, keepdims=True) + WEIGHT))
    room = np.log10(n + 0.5 * (v + 1))
    v = vocabulary
    return Model(words, v.frequent, v.tokens, v.types, v.ends, of, transition, room)


SCORED = "id {}, held_out boolean, n_tokens long, known long, part double, path double, row long"


def score(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Scores of rows (id, held_out, raw): the contract's columns and the perplexity."""
    return score_coded(coded(rows, model.frequent, model.ends), model, counts)


def score_coded(texts: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Scores of coded rows."""
    kind = texts.schema["id"].dataType.simpleString()
    names = ["id", "held_out", "n_tokens", "known", "part", "path", "row"]
    own, of, transition, room = model.own, model.of, model.transition, model.room
    listed = Listed([w for w in model.frequent if w != END])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(listed, own)
        for batch in batches:
            for some, items, _, _, _ in known.texts(batch):
                at = of[items]
                steps = transition[at[:-1], at[1:]] - room[at[1:]]
                edges = np.cumsum([0, *some.column(4).to_pylist()]).tolist()
                path = [float(steps[a:b].sum()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[2:7], pa.array(path, pa.float64()), some.column(7)], names)

    asked = texts.select("codes", "hashes", "id", "held_out", "n_tokens", "known", "part", "row")
    parts = asked.mapInArrow(run, SCORED.format(kind))
    each = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
    least = min(model.frequent.values(), default=None)
    others = counts if least is None else counts.where(F.col("c") < least)
    looked = each.join(others.withColumnRenamed("w", "rare"), "rare", "left")
    sums = looked.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("seen"),
    )
    joined = parts.join(sums, "row", "left")
    counts_part = F.col("part") + F.coalesce("more", F.lit(0.0))
    total = counts_part + F.col("path")
    return joined.select(
        "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (counts_part - F.col("n_tokens") * model.base_room).alias("base_score"),
        total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def op3_brown(spark: SparkSession, folder: str) -> DataFrame:
    documents = common.table(spark, folder, "documents")
    held_out = common.remainder("doc_id", 5) == 1
    rows = documents.select(F.col("doc_id").alias("id"), held_out.alias("held_out"), F.col("text").cast("binary").alias("raw"))
    words = vocabulary(rows.where("not held_out"))
    texts = coded(rows, words.frequent, words.ends)
    model = learn(texts.where("not held_out"), words)
    return score_coded(texts, model, words.counts).withColumnRenamed("id", "doc_id")
