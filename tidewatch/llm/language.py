"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (one to three letters, words padded with a space)
of all training texts of a language, a document's that of the whole text. The out-of-place distance
adds up how far each of the document's n-grams stands from its place in a profile (at most the
profile's length, which is also what an absent one costs); the nearest language wins, ties go to the
first by name. The score is 1 minus the distance's share of its maximum.

n-gram counts are added up per task, then in Spark, over all training rows. What reaches the driver
are the profiles: ``PROFILE`` rows a language. Scoring is one narrow pass.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be
learned. Rows with a null language are not learned from; a null id has the remainder of the empty
text; equal texts get equal answers. Other columns are not read (``identify``) or kept (``keep``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm import common

PROFILE = 400
# Grams counted in a task before they are merged.
MERGE = 500_000
UNKNOWN = "und"


class Letters:
    """Which code points are letters; the table grows with the code points met."""

    def __init__(self):
        self.table = np.zeros(0, bool)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        top = int(codes.max()) + 1
        if top > len(self.table):
            more = [chr(c).isalpha() for c in range(len(self.table), top)]
            self.table = np.concatenate([self.table, np.array(more, bool)])
        return self.table[codes]


def grams(text: str, letters: Letters) -> np.ndarray:
    """All n-grams of the words of a text; one code point takes 21 bits."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if not len(codes):
        return codes
    codes = np.concatenate([[32], np.where(letters(codes), codes, 32), [32]])
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    space = codes == 32
    if len(codes) < 3:
        return codes[:0]
    two = codes[:-1] << 21 | codes[1:]
    three = two[:-1] << 21 | codes[2:]
    return np.concatenate([codes[~space], two, three[~space[1:-1]]])


def top_grams(text: str | None, letters: Letters, size: int) -> np.ndarray:
    """The most frequent n-grams of a text, in order; ties by code."""
    found, counts = np.unique(grams(text or "", letters), return_counts=True)
    return found[np.lexsort((found, -counts))[:size]]


def learn(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """Profiles of all rows with a language: lang, gram, place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, totals, waiting, held = Letters(), {}, {}, 0

        def merge():
            for name, parts in waiting.items():
                keys, counts = totals.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                new, n = np.unique(np.concatenate(parts), return_counts=True)
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                totals[name] = keys, np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
            waiting.clear()

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = grams(value.as_py(), letters)
                waiting.setdefault(name, []).append(found)
                held += len(found)
                if held > MERGE:
                    merge()
                    held = 0
        merge()
        for name, (keys, counts) in totals.items():
            for at in range(0, len(keys), 100_000):
                k, n = keys[at : at + 100_000], counts[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(n)], ["lang", "gram", "n"]
                )

    asked = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    asked = asked.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = asked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).drop("n")


class Profiles:
    """The profiles as sorted arrays; answers for a batch of texts."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.names, self.sorted = size, sorted({r[0] for r in rows}), []
        for name in self.names:
            pairs = sorted((g, p - 1) for n, g, p in rows if n == name)
            self.sorted.append((np.array([g for g, _ in pairs]), np.array([p for _, p in pairs])))
        self.letters = Letters()

    def answer(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        tops = [top_grams(t, self.letters, self.size) for t in texts]
        sizes = np.array([len(t) for t in tops])
        some = np.flatnonzero(sizes)
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not len(some) or not self.names:
            return names, scores
        flat = np.concatenate(tops)
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        place = np.arange(len(flat)) - np.repeat(starts, sizes[some])
        far = np.empty((len(self.names), len(some)), np.int64)
        for i, (keys, places) in enumerate(self.sorted):
            at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
            apart = np.where(keys[at] == flat, np.abs(places[at] - place), self.size)
            far[i] = np.add.reduceat(np.minimum(apart, self.size), starts)
        best = far.argmin(axis=0)
        share = 1 - far.min(axis=0) / (self.size * sizes[some])
        for d, b, s in zip(some.tolist(), best.tolist(), share.tolist(), strict=True):
            names[d], scores[d] = self.names[b], s
        return names, scores


def collected(profiles: DataFrame) -> list[tuple[str, int, int]]:
    """The profiles on the driver: their length times the number of languages."""
    with common.tidy(profiles.sparkSession):
        return [tuple(r) for r in profiles.select("lang", "gram", "place").collect()]


def identify(df: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE) -> DataFrame:
    """df with lang_pred and score, which replace columns of these names."""
    rows = collected(profiles)
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    inner = [f"_c{i}" for i in range(len(kept))]
    fields = [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(inner, kept, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(rows, size)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                names, scores = known.answer(part.column(at_text).to_pylist())
                answers = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *answers], [*inner, "lang_pred", "score"])

    asked, at_text = df.select(*[F.col(c).alias(n) for n, c in zip(inner, kept, strict=True)]), kept.index(text)
    schema = ", ".join([*fields, "lang_pred string, score double"])
    return asked.mapInArrow(run, schema).toDF(*kept, "lang_pred", "score")


def split(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """df with held_out: the rows that no profile may be learned from."""
    return df.withColumn("held_out", common.remainder(doc_id, 4) == 2)


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = common.table(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = learn(split(documents).where("not held_out"))
    answered = identify(split(documents.select("doc_id", "text")), profiles)
    return answered.select("doc_id", "held_out", "lang_pred", "score")
