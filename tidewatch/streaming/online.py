"""Event-time panels, scoring of new rows against fitted thresholds, and alarms."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


# State that grows with the keys is kept outside the heap; the processor below asks for it.
STORE = "spark.sql.streaming.stateStore.providerClass"
DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream, ts as a timestamp (watermarks need one).

    ``files_per_batch`` bounds what one batch takes on from a backlog.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def advance(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over what is available now into ``path``; a later call goes on from there."""
    with _store(stream.sparkSession):
        job = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", f"{path}/rows")
            .option("checkpointLocation", f"{path}/progress")
            .trigger(availableNow=True)
            .start()
        )
    job.awaitTermination()


@contextlib.contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, unless the session names another store."""
    if spark.conf.get(STORE, None) not in (None, "", DEFAULT_STORE):
        yield
        return
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def results(stream: DataFrame, path: str) -> DataFrame:
    """The rows written so far by :func:`advance`."""
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def panel(
    events: DataFrame, keys: Sequence[str], value: str, width: str, slide: str | None = None, late: str = "1 hour"
) -> DataFrame:
    """Aggregates per event-time window; rows later than ``late`` are dropped."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(*keys, span.alias("span")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top")
    )
    return out.select(*keys, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n", "total", "top")


def alarms(flags: DataFrame, keys: Sequence[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Flagged rows closer than ``gap`` merged into one alarm per key."""
    session = F.session_window("ts", gap)
    out = flags.withWatermark("ts", late).groupBy(*keys, session.alias("span")).agg(F.count("*").alias("n_flags"))
    return out.select(*keys, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n_flags")


def score(
    events: DataFrame,
    key: str,
    value: str,
    length: int,
    order: str | Sequence[str] = "event_id",
    state_rows: int | None = None,
) -> DataFrame:
    """Score each new row by the error of its trailing window against the window mean.

    Per key the last ``length - 1`` values are kept as state, so a row is scored with rows of
    earlier batches. Rows must reach the stream in order between batches; inside a batch
    they are put in ``order`` here (event time first, then what breaks its ties), so one batch's rows of a
    key should fit into a task (bound the batch with ``files_per_batch``). The state of a key stays as
    long as the query. Output: (key, order, score), null while the window is not full.
    """
    kept = length - 1 if state_rows is None else state_rows
    places = [order] if isinstance(order, str) else list(order)
    kinds = dict(events.dtypes)
    out = ", ".join([*(f"{c} {kinds[c]}" for c in (key, *places)), "score double"])

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail = np.array(state.get[0] if state.exists else [], dtype=float)
        fresh = pd.concat(list(batches)).sort_values(places)
        seen = np.concatenate([tail, fresh[value].to_numpy(dtype=float)])
        scores = np.full(len(fresh), np.nan)
        if len(seen) >= length:
            wins = np.lib.stride_tricks.sliding_window_view(seen, length)
            scores[len(fresh) - len(wins) :] = wins.var(axis=1)
        state.update(([float(v) for v in seen[len(seen) - min(kept, len(seen)) :]],))
        yield pd.DataFrame({key: k[0], **{c: fresh[c].to_numpy() for c in places}, "score": scores})

    scored = events.select(key, *places, value).groupBy(key).applyInPandasWithState(
        step, out, "tail array<double>", "append", "NoTimeout"
    )
    return scored.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def score_in_order(
    events: DataFrame,
    key: str,
    value: str,
    length: int,
    ties: Sequence[str] = ("event_id",),
    ts: str = "ts",
    late: str = "1 hour",
    idle: timedelta = timedelta(days=30),
) -> DataFrame:
    """Score each row by the error of its trailing window, in event time across batches.

    Rows wait in the state until the watermark (``late`` behind the newest row) has passed them, and then are scored
    in the order of ``ts`` and ``ties``, so a row that comes late within the watermark stands in the same windows as in
    one sorted table; later ones are dropped by the watermark. Per key the state holds the last ``length`` - 1 values and the
    rows of the last ``late``. Windows begin anew where no row of a key lies for ``idle``, whatever the batches; event-time
    timers release waiting rows, and remove the values of a key once the watermark is as far past its last row. Rows of a key with a null value are scored as null and stand in no window.
    Output: (key, ts, ties, score), null while the window is not full; rows newer than the watermark are not out yet.
    """
    from pyspark.sql.streaming import StatefulProcessor

    kept, fields = length - 1, [f for f in events.schema.fields if f.name in ties]
    fields = sorted(fields, key=lambda f: list(ties).index(f.name))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    row_kind = f"at_us bigint, {kinds}, at_value double"
    key_kind = events.schema[key].dataType.simpleString()
    names, pause = [f.name for f in fields], int(idle.total_seconds() * 1000)
    row = Row(key, "at_us", *names, "score")

    def runs(rows: list[tuple]) -> Iterator[list[tuple]]:
        """Rows in order, cut where nothing has come for ``idle``."""
        begin = 0
        for i, r in enumerate(rows):
            if i and r[0] // 1000 - rows[i - 1][0] // 1000 >= pause:
                yield rows[begin:i]
                begin = i
        if rows:
            yield rows[begin:]

    class InOrder(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.tail = handle.getValueState("tail", "v array<double>, last bigint")
            self.waiting = handle.getListState("waiting", row_kind)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            fresh = [tuple(r[c] for c in ("at_us", *names, "at_value")) for r in rows]
            self.waiting.appendList(fresh)
            # The watermark passes a row once it is as late as its millisecond.
            self.handle.registerTimer(min(r[0] for r in fresh) // 1000)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            mark = timerValues.getCurrentWatermarkInMs()
            held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: [(x is not None, x) for x in r[:-1]])
            ready = [r for r in held if r[0] // 1000 <= mark]
            rest = held[len(ready) :]
            values, last = self.tail.get() or ([], None)
            scores: list[float] = []
            for run in runs(ready):
                if last is not None and run[0][0] // 1000 - last >= pause:
                    values = []
                seen = np.array([*values, *(np.nan if r[-1] is None else r[-1] for r in run)], float)
                out = np.full(len(seen), np.nan)
                on = np.flatnonzero(~np.isnan(seen))
                if len(on) >= length:
                    out[on[length - 1 :]] = np.lib.stride_tricks.sliding_window_view(seen[on], length).var(axis=1)
                scores += out[len(values) :].tolist()
                values, last = seen[on][len(on) - min(kept, len(on)) :].tolist(), run[-1][0] // 1000
            if last is not None and mark >= last + pause:
                self.tail.clear()
            elif ready:
                self.tail.update((values, last))
                self.handle.registerTimer(last + pause)
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000)
            else:
                self.waiting.clear()
            for r, x in zip(ready, scores, strict=True):
                yield row(key[0], *r[:-1], x)

        def close(self) -> None:
            pass

    asked = events.withWatermark(ts, late).where(F.col(ts).isNotNull())
    asked = asked.select(key, ts, F.unix_micros(ts).alias("at_us"), *names, F.col(value).cast("double").alias("at_value"))
    scored = asked.groupBy(key).transformWithState(
        InOrder(), f"{key} {key_kind}, at_us bigint, {kinds}, score double", "append", "EventTime"
    )
    return scored.select(
        key, F.timestamp_micros("at_us").alias(ts), *names, F.when(~F.isnan("score"), F.col("score")).alias("score")
    )


def flag(scored: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """Stream of scores with pred, from a fitted static threshold table; null for a key without one."""
    out = scored.where(F.col("score").isNotNull()).join(thresholds, key, "left")
    return out.withColumn("pred", (F.col("score") > F.col("threshold")).cast("int"))
