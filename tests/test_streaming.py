"""Streams in event time against their batch twins."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewatch.streaming import online

KIND = "user_id int, event_id long, ts timestamp, value double"
START = datetime(2024, 1, 1)


def batch_twin(rows, length):
    """Scores of all rows, each user's in order of time."""
    out = {}
    for user in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1]))
        values = [r[3] for r in mine]
        for i, r in enumerate(mine):
            out[r[1]] = float(np.var(values[i - length + 1 : i + 1])) if i + 1 >= length else None
    return out


def run(spark, folder, batches, **how):
    inbox, out = f"{folder}/in", f"{folder}/out"
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(inbox)
        stream = online.score_in_order(online.read_events(spark, inbox), "user_id", "value", 4, **how)
        online.advance(stream, out)
    return online.results(stream, out)


def test_late_rows_stand_in_the_windows_of_the_batch_twin(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), i, START + timedelta(minutes=10 * i), float(rng.normal())) for i in range(90)]
    # Equal times, told apart by the id.
    rows += [(0, 200 + i, rows[30][2], float(i)) for i in range(3)]
    rows.sort(key=lambda r: r[2] + timedelta(minutes=int(rng.integers(0, 55))))
    got = {r.event_id: r for r in run(spark, tmp_path, [rows[:30], rows[30:31], rows[31:70], rows[70:]]).collect()}
    want, mark = batch_twin(rows, 4), max(r[2] for r in rows) - timedelta(hours=1)
    assert set(got) == {r[1] for r in rows if r[2] <= mark}
    for i, r in got.items():
        assert r.score == pytest.approx(want[i]) if want[i] is not None else r.score is None
    assert {i: r.ts for i, r in got.items()} == {r[1]: r[2] for r in rows if r[1] in got}


def test_rows_beyond_the_watermark_are_dropped_and_nulls_are_no_window(spark, tmp_path):
    at = [START + timedelta(hours=h) for h in range(12)]
    first = [(1, i, at[i], float(i) if i != 3 else None) for i in range(8)]
    got = run(spark, tmp_path, [first, [(1, 50, at[2], 99.0), (1, 51, at[11], 1.0)]]).collect()
    scores = {r.event_id: r.score for r in got}
    assert 50 not in scores and scores[3] is None and sorted(scores) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert scores[4] == pytest.approx(np.var([0, 1, 2, 4])) and scores[2] is None


def test_idle_keys_leave_the_state(spark, tmp_path):
    rows = [(1, i, START + timedelta(minutes=i), float(i * i)) for i in range(6)]
    other = [(2, 100 + d, START + timedelta(days=d), 0.0) for d in range(1, 4)]
    back = [(1, 50 + i, START + timedelta(days=4, minutes=i), float(i)) for i in range(5)]
    end = [(2, 200, START + timedelta(days=9), 0.0)]
    got = run(spark, tmp_path, [rows, other, back, end], idle=timedelta(days=1)).collect()
    scores = {r.event_id: r.score for r in got if r.user_id == 1}
    # The first windows after the pause are not full again until four rows have come.
    assert [scores[50 + i] for i in range(3)] == [None] * 3 and scores[53] == pytest.approx(np.var([0, 1, 2, 3]))
    assert scores[5] == pytest.approx(np.var([4, 9, 16, 25]))
    held = spark.read.format("statestore").option("path", f"{tmp_path}/out/progress").option("stateVarName", "tail").load()
    # Nine days on, both keys' earlier values are gone but for the last row's key, if it was released.
    assert held.where("key.user_id = 1").count() == 0


def test_rows_without_a_key_stay_apart(spark, tmp_path):
    """A null key is a key of its own, and takes no rows of others; a null tie comes first."""
    rows = [(None if i % 5 == 0 else i % 3, i, START + timedelta(minutes=i), float(i * i % 17)) for i in range(90)]
    rows += [(1, None, rows[40][2], 3.0), (1, 200, START + timedelta(days=1), 0.0)]
    got = {r.event_id: r for r in run(spark, tmp_path, [rows]).collect()}
    mine = {r[1]: r[0] for r in rows if r[1] != 200}
    assert {i: r.user_id for i, r in got.items()} == mine
    for user in (None, 0, 2):
        values = [(r[1], r[3]) for r in rows if r[0] == user]
        for at, (i, _) in enumerate(values):
            want = float(np.var([v for _, v in values[at - 3 : at + 1]])) if at > 2 else None
            assert got[i].score == pytest.approx(want) if want is not None else got[i].score is None
