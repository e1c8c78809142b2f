"""Ranked lexical search by one scan of the documents, without an index of them.

The terms of all items are compiled into an Aho-Corasick automaton whose patterns carry a boundary guard: a text becomes
bytes in which every byte outside terms is a space, with a space around the whole, and a pattern is ``" term "``. So the automaton finds exactly
the whole terms, all of them in one pass whatever their number, and an output leads to a term and from there to
its items. The automaton lies in the shared folder, and each task loads it once.

1. Each document is scanned once: its number of terms, and the item terms in it with their counts, are written as a table.
2. Documents, terms in all, and documents per item term are added up from that table.
3. Scores of a batch of documents for all items are added up from (document, term, items of the term); a task keeps
   the ``top`` best documents per item, so that at most tasks x top rows per item are shuffled.

Items are cut into blocks of about ``BLOCK_TERMS`` (item, term) pairs, an item in one block. Each block has its own automaton, scan and
scores, so that neither driver nor tasks hold more than a block, and one more scan is the price of each block.
All arithmetic but the weight's logarithm is in whole numbers.

Null texts and texts without a term are no documents of the collection and are not ranked. Items of equal id, null ids
among them, are one item with the terms of all its rows; an item without a term, or whose terms occur nowhere, has no rows.
Repeated document rows are documents of their own; null document ids come last among equal scores. Texts
of any length are scanned whole, ``CHUNK`` bytes or one text at a time. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm import common

TOP = 50
# (item, term) pairs of a block.
BLOCK_TERMS = 200_000
# Documents that a task scores where there are tasks for all cores.
TASK_DOCUMENTS = 500_000
# Bytes of text scanned at once, and scores held at once.
CHUNK, CELLS = 2 << 20, 2_000_000
# Largest whole number up to which doubles are exact.
EXACT = 1 << 53

# A-Z become a-z; bytes that are in no term become spaces.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Block:
    """The automaton of some items' terms and the items of each term."""

    def __init__(self, pairs: list[tuple[int, bytes]]):
        import ahocorasick

        terms = sorted({t for _, t in pairs})
        number = {t: i for i, t in enumerate(terms)}
        self.size = len(terms)
        self.items = np.array(sorted({i for i, _ in pairs}), np.int64)
        place = {i: k for k, i in enumerate(self.items.tolist())}
        links = np.array(sorted({(number[t], place[i]) for i, t in pairs}), np.int64).reshape(-1, 2)
        #: Items of term t: owners[first[t]:first[t + 1]].
        self.owners = links[:, 1]
        self.first = np.searchsorted(links[:, 0], np.arange(self.size + 1))
        #: The most terms of one item.
        self.most = int(np.bincount(links[:, 1]).max(initial=0))
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            # A byte is a character; the guards make it a whole term.
            self.automaton.add_word(f" {t.decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms per text; and text, term and count of each item term that occurs in a text."""
        raw = b" " + b"  ".join(texts).translate(FOLD) + b" "
        ends = np.cumsum([len(t) + 2 for t in texts])
        space = np.frombuffer(raw, np.uint8) == 32
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        n = np.diff(np.searchsorted(starts, ends), prepend=0)
        kind = np.dtype([("end", np.int64), ("term", np.int64)])
        found = np.fromiter(self.automaton.iter(raw.decode("latin-1")), kind)
        text = np.searchsorted(ends, found["end"] - 1, side="right")
        key, tf = np.unique(text * max(1, self.size) + found["term"], return_counts=True)
        return n, key // max(1, self.size), key % max(1, self.size), tf


@lru_cache(maxsize=1)
def load(path: str) -> Block:
    block = Block.__new__(Block)
    vars(block).update(pickle.loads(common.get(path)))
    return block


def item_terms(items: DataFrame, text: str) -> DataFrame:
    """item, term: the distinct terms of each item's rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = sorted(set(terms_of(value.as_py())))
                arrays = [pa.array([item] * len(mine), pa.int64()), pa.array(mine, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["item", "term"])

    return items.select("item", F.col(text)).mapInArrow(cut, "item long, term binary").distinct()


def save_blocks(pairs: DataFrame, block_terms: int = BLOCK_TERMS) -> list[str]:
    """Compile blocks of items into files of the shared folder: one path for each block."""
    folder = common.scratch(pairs.sparkSession, "terms")
    parts = max(1, -(-pairs.count() // block_terms))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, paths, context = [], [], TaskContext.get()

        def flush() -> None:
            path = f"{folder}/{context.partitionId()}-{len(paths)}-{context.taskAttemptId()}"
            common.put(path, pickle.dumps(vars(Block(held))))
            paths.append(path)

        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # A block ends with an item.
                if len(held) >= block_terms and pair[0] != held[-1][0]:
                    flush()
                    held = []
                held.append(pair)
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    # Partitions of whole items are joined, so that there are no more blocks than the pairs fill.
    dealt = pairs.repartition("item").coalesce(parts).sortWithinPartitions("item")
    return sorted(r.path for r in common.stored(dealt.mapInArrow(save, "path string")).collect())


def scan(documents: DataFrame, path: str) -> DataFrame:
    """doc, n, terms, tfs of each document with a term: n terms in all, and the block's terms in it with their counts."""
    kind = documents.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = load(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and (not texts or size < CHUNK):
                    texts.append(batch.column(1)[at + len(texts)].as_py() or b"")
                    size += len(texts[-1])
                n, text, term, tf = block.counts(texts)
                ends = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
                arrays = [
                    batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
                ]
                out = pa.RecordBatch.from_arrays(arrays, ["doc", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))
                at += len(texts)

    return documents.mapInArrow(run, f"doc {kind}, n long, terms array<int>, tfs array<int>")


def holders(scanned: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of a block's terms; ``size`` is at most a block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten(), minlength=size)
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(df[on])], ["term", "df"])

    counts = scanned.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for r in counts.collect():
        out[r.term] = r.df
    return out


def best(held: list[pa.Table], top: int) -> pa.Table:
    """The ``top`` first rows of each item: highest score, then smallest document."""
    table = pa.concat_tables(held)
    order = pc.sort_indices(
        table, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc", "ascending")], null_placement="at_end"
    )
    table = table.take(order)
    item = table.column("item").to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    place = np.arange(len(item)) - np.repeat(begins, np.diff(np.append(begins, len(item))))
    return table.filter(pa.array(place < top))


def scored(scanned: DataFrame, path: str, weights: np.ndarray, total: int, length: int, top: int) -> DataFrame:
    """item, score, doc: of each task, the best documents per item. ``total`` documents have ``length`` terms together."""
    kind = scanned.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = load(path), None
        many = len(block.items)
        # A score is at most this; as doubles the sums are whole numbers up to EXACT.
        exact = int(weights.max(initial=0)) * 1_000_000 * block.most < EXACT
        least = np.ones(many, np.int64)
        for batch in batches:
            step = max(1, CELLS // max(1, many))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                # Python's whole numbers have no bound.
                m = np.array([50 + 50 * n * total // length for n in part.column(1).to_pylist()], np.int64)
                lists = part.column(2)
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                term = lists.flatten().to_numpy().astype(np.int64)
                tf = part.column(3).flatten().to_numpy().astype(np.int64)
                gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                each = np.diff(block.first)[term]
                # Every (document, term) once for each item of the term.
                which = np.repeat(block.first[term] - np.cumsum(each) + each, each) + np.arange(each.sum())
                cell = np.repeat(doc * many, each) + block.owners[which]
                if exact:
                    score = np.bincount(cell, np.repeat(gain, each), part.num_rows * many).astype(np.int64)
                else:
                    score = np.zeros(part.num_rows * many, np.int64)
                    np.add.at(score, cell, np.repeat(gain, each))
                row, item = np.nonzero(score.reshape(-1, many) >= least)
                names = ["item", "score", "doc"]
                values = [pa.array(item), pa.array(score[row * many + item]), part.column(0).take(pa.array(row))]
                new = pa.table(values, names)
                held = best([new] if held is None else [held, new], top)
                # From now on a document needs the score of an item's last one.
                item = held.column("item").to_numpy()
                full = np.bincount(item, minlength=many) >= top
                last = np.full(many, np.iinfo(np.int64).max)
                np.minimum.at(last, item, held.column("score").to_numpy())
                least = np.where(full, last, 1)
        if held is not None:
            numbered = held.set_column(0, "item", pa.array(block.items[held.column("item").to_numpy()]))
            yield from numbered.combine_chunks().to_batches()

    return scanned.mapInArrow(run, f"item long, score long, doc {kind}")


def search(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item id, rank, doc id, score: each item's ``top`` best documents with a score above 0."""
    asked = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    named = common.stored(asked.select("id").distinct().withColumn("item", F.monotonically_increasing_id()))
    rows = asked.join(named.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id"))).select("item", "text")
    paths = save_blocks(common.stored(item_terms(rows, "text")), block_terms)
    texts = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").cast("binary").alias("raw"))
    found, total, length = [], None, None
    for path in paths:
        block = load(path)
        scanned = common.stored(scan(texts, path))
        if total is None:
            total, length = scanned.agg(F.count("*"), F.sum("n")).first()
        if not total:
            continue
        df = holders(scanned, block.size)
        weights = np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)
        # Each task passes on its own best documents, so there are no more tasks than are of use.
        tasks = max(2 * texts.sparkSession.sparkContext.defaultParallelism, total // TASK_DOCUMENTS)
        found.append(common.stored(scored(scanned.coalesce(tasks), path, weights, total, length, top)))
    if not found:
        kind = texts.schema["doc"].dataType.simpleString()
        found = [texts.sparkSession.createDataFrame([], f"item long, score long, doc {kind}")]
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ranked.join(named, "item")
    return out.select(F.col("id").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def op12_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return search(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))


# The same rows by counting every term of every document.
OP12_SQL = r"""
WITH dt AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents WHERE text IS NOT NULL),
it AS (
  SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL)),
len AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
tot AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
tf AS (SELECT doc_id, t, count(*) AS tf FROM dt WHERE t IN (SELECT t FROM it) GROUP BY doc_id, t),
w AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), tot),
m AS (SELECT doc_id, 50 + ((50 * n * docs) // terms) AS m FROM len, tot),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM tf JOIN m USING (doc_id) JOIN w USING (t) JOIN it USING (t) GROUP BY item_id, doc_id),
r AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k
  FROM s WHERE score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM r WHERE k <= 50
"""
