"""Readers on small files of the documented shapes, and streams against their batch twins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.plans import tables
from tidewatch.sources import readers, sinks
from tidewatch.streaming import online


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_matrix_keeps_line_order_over_splits(spark, tmp_path):
    """The files are cut into many splits; t is still the line number."""
    for machine, n in (("machine-1-1", 900), ("machine-1-2", 7)):
        write(tmp_path / "train", f"{machine}.txt", "\n".join(f"{i},{i * 2}" for i in range(n)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = readers.matrix(spark, str(tmp_path / "train"))
        out = df.toPandas()
        assert df.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(out) == 907
    assert all(v[0] == t and v[1] == 2 * t for t, v in zip(out["t"], out["values"]))
    assert [r[0] for r in readers.entities(spark, str(tmp_path / "train")).collect()] == ["machine-1-1", "machine-1-2"]
    assert readers.entities(spark, str(tmp_path / "none")).count() == 0


def test_npy(spark, tmp_path):
    array = np.arange(12, dtype=np.float32).reshape(6, 2)
    np.save(tmp_path / "P-1.npy", array)
    out = readers.npy(spark, str(tmp_path)).orderBy("t").collect()
    assert [r["series_id"] for r in out] == ["P-1"] * 6
    np.testing.assert_array_equal([r["values"] for r in out], array)


def test_channel_labels(spark, tmp_path):
    write(
        tmp_path,
        "channels.csv",
        'chan_id,spacecraft,anomaly_sequences,class,num_values\nP-1,SMAP,"[[20, 40], [60, 75]]","[point]",900\n'
        'M-1,MSL,"[[1, 3]]",[x],10\nP-1,SMAP,"[[7, 8]]",[x],900\nA-1,SMAP,[],[x],5\n',
    )
    table = readers.channel_table(spark, str(tmp_path / "channels.csv"))
    assert [r[0] for r in readers.channels(table).collect()] == ["P-1", "M-1", "A-1"]
    assert [r[0] for r in readers.channels(table, "SMAP").collect()] == ["P-1", "A-1"]
    spans = readers.intervals(table, "P-1").orderBy("seg_id").collect()
    assert [(r["start_t"], r["end_t"], r["n"]) for r in spans] == [(20, 40, 900), (60, 75, 900)]
    assert readers.intervals(table).count() == 3
    with pytest.raises(ValueError):
        readers.intervals(table, "X-9")


def test_interpretation_labels(spark, tmp_path):
    write(tmp_path, "machine-1-1.txt", "120-180:1,9,10\n300-340:1\n")
    out = readers.interpretation_labels(spark, str(tmp_path)).orderBy("start_t").collect()
    assert out[0]["series_id"] == "machine-1-1" and out[0]["dims"] == [1, 9, 10]
    assert (out[1]["start_t"], out[1]["end_t"]) == (300, 340)


PLANT = """ Timestamp, FIT101, LIT101 ,Normal/Attack
28/12/2015 10:00:01 AM,1.5,{bad},A ttack
28/12/2015 10:00:00 AM,1.0,10,Normal
28/12/2015 10:00:02 AM,2.0,14,Attack
"""


def test_plant_csv(spark, tmp_path):
    write(tmp_path, "good.csv", PLANT.format(bad="11"))
    write(tmp_path, "bad.csv", PLANT.format(bad="oops"))
    out = readers.plant_csv(spark, str(tmp_path / "good.csv")).orderBy("t").collect()
    assert [(r["t"], r["y"], r["FIT101"], r["LIT101"]) for r in out] == [(0, 0, 1.0, 10.0), (1, 1, 1.5, 11.0), (2, 1, 2.0, 14.0)]
    with pytest.raises(ValueError):
        readers.plant_csv(spark, str(tmp_path / "bad.csv"))
    out = readers.plant_csv(spark, str(tmp_path / "bad.csv"), on_bad="impute").orderBy("t").collect()
    assert [r["LIT101"] for r in out] == [10.0, 12.0, 14.0]
    with pytest.raises(ValueError):
        readers.plant_csv(spark, str(tmp_path / "good.csv"), features=["MV101"])


def test_multiheader(spark, tmp_path):
    write(tmp_path, "cluster.csv", "date,host1,host1,host2,label\ndate,cpu,mem,cpu,label\nd,1,2,3,0\nd,4,,6,1\n")
    out = readers.multiheader(spark, str(tmp_path / "cluster.csv")).orderBy("t", "node", "metric").collect()
    assert [(r["t"], r["node"], r["metric"], r["x"]) for r in out] == [
        (0, "host1", "cpu", 1.0), (0, "host1", "mem", 2.0), (0, "host2", "cpu", 3.0),
        (1, "host1", "cpu", 4.0), (1, "host1", "mem", None), (1, "host2", "cpu", 6.0),
    ]


def test_trials_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, "COMPLETE", 0.5)], "study string, trial int, state string, value double")
    sinks.append_trials(rows, str(tmp_path / "t"))
    sinks.append_trials(rows.withColumn("trial", F.lit(1)), str(tmp_path / "t"))
    assert sinks.load_trials(spark, str(tmp_path / "t"), "s").count() == 2


def test_stream_score_over_many_batches(spark, tmp_path):
    """State carries windows over batches: the same scores as in one batch."""
    rng = np.random.default_rng(0)
    n = 60
    pdf = pd.DataFrame({"event_id": np.arange(n), "user_id": rng.integers(0, 3, n), "value": rng.random(n)})
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["event_id"], unit="min")
    for a, b in ((0, 7), (7, 30), (30, n)):
        spark.createDataFrame(pdf[a:b]).write.mode("append").parquet(str(tmp_path / "in"))
        stream = online.score(online.read_events(spark, str(tmp_path / "in")), "user_id", "value", 5)
        online.advance(stream, str(tmp_path / "out"))
    got = online.results(stream, str(tmp_path / "out")).toPandas().sort_values("event_id")
    want = pdf.groupby("user_id")["value"].transform(lambda s: s.rolling(5).var(ddof=0))
    assert len(got) == n
    np.testing.assert_allclose(got["score"].astype(float), want, atol=1e-12)


def test_late_rows_are_dropped(spark, tmp_path):
    def arrive(rows):
        pdf = pd.DataFrame(rows, columns=["ts", "event_type", "value"])
        pdf["ts"] = pd.to_datetime(pdf["ts"])
        spark.createDataFrame(pdf).write.mode("append").parquet(str(tmp_path / "in"))
        stream = online.panel(online.read_events(spark, str(tmp_path / "in")), ["event_type"], "value", "1 hour", late="1 hour")
        online.advance(stream, str(tmp_path / "out"))
        return stream

    arrive([("2024-01-01 00:10", "a", 1.0), ("2024-01-01 05:00", "a", 2.0)])
    stream = arrive([("2024-01-01 00:20", "a", 9.0), ("2024-01-01 09:00", "a", 4.0)])
    out = online.results(stream, str(tmp_path / "out")).orderBy("start").collect()
    assert [(r["start"].hour, r["total"]) for r in out] == [(0, 1.0), (5, 2.0)]


def test_window_flags_repeat(spark):
    """The flagship gives the same rows whatever the partitioning of the shuffle."""
    folder = "/root/testdata/sf0.001"
    first = sorted(map(tuple, tables.window_flags(spark, folder).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, tables.window_flags(spark, folder).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_part_files_in_order_of_their_numbers(spark, tmp_path):
    folder = tmp_path / "m" / "machine-1"
    folder.mkdir(parents=True)
    for i, part in enumerate((9, 10000, 99999, 100000, 100001)):
        (folder / f"part-{part}.txt").write_text(f"{i}\n")
    got = readers.matrix(spark, str(tmp_path / "m"), folders=True, features=["x"]).orderBy("t").collect()
    assert [(r.t, r.x) for r in got] == [(i, float(i)) for i in range(5)]


def test_header_stands_in_the_first_file_by_name(spark, tmp_path):
    folder = tmp_path / "cluster"
    folder.mkdir()
    (folder / "part-2.csv").write_text("date,a,b,label\ndate,cpu,mem,label\n2024,1,2,0\n")
    (folder / "part-9.csv").write_text("".join(f"2024,{i},0,0\n" for i in range(2, 40)))
    (folder / "part-10.csv").write_text("".join(f"2024,{i},0,0\n" for i in range(40, 4000)))
    got = readers.multiheader(spark, str(folder))
    assert {(r.node, r.metric) for r in got.select("node", "metric").distinct().collect()} == {("a", "cpu"), ("b", "mem")}
    before = sorted(map(str, got.collect()))
    rows = got.where("node = 'a'").orderBy("t").collect()
    assert [r.t for r in rows] == list(range(3999)) and [r.x for r in rows] == [float(i + 1) for i in range(3999)]
    (folder / "part-2.csv").write_text("2024,1,2,0\n")
    given = readers.multiheader(spark, str(folder), header=(["date", "a", "b", "label"], ["date", "cpu", "mem", "label"]))
    assert sorted(map(str, given.collect())) == before


def test_channels_with_their_labels(spark, tmp_path):
    import numpy as np

    folder = tmp_path / "arrays"
    folder.mkdir()
    np.save(folder / "P-1.npy", np.arange(10.0).reshape(5, 2))
    np.save(folder / "Q-2.npy", np.zeros((3, 2)))
    labels = tmp_path / "labels.csv"
    labels.write_text('chan_id,spacecraft,anomaly_sequences,class,num_values\nP-1,SMAP,"[[1, 2], [4, 9]]",x,5\nZ-9,MSL,"[[0, 1]]",x,2\n')
    got = readers.labelled_channels(spark, str(folder), str(labels)).orderBy("series_id", "t").collect()
    assert [(r.series_id, r.y) for r in got] == [("P-1", 0), ("P-1", 1), ("P-1", 1), ("P-1", 0), ("P-1", 1)] + [("Q-2", 0)] * 3
    assert got[1]["values"] == [2.0, 3.0]


def test_stream_score_in_event_time(spark, tmp_path):
    """Ids run against time."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    stamp = lambda i: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i)).to_pydatetime()

    def arrive(first, n):
        rows = [(1000 - i, stamp(i), 1, float(i * i)) for i in range(first, first + n)]
        df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
        df.coalesce(1).write.mode("append").parquet(inbox)
        stream = online.read_events(spark, inbox)
        scored = online.score(stream, "user_id", "value", 3, ["ts", "event_id"])
        online.advance(scored, out)
        return {r.event_id: r.score for r in online.results(scored, out).collect()}

    arrive(0, 4)
    got = arrive(4, 3)
    for i in range(7):
        want = None if i < 2 else float(np.var([(i - 2.0) ** 2, (i - 1.0) ** 2, float(i) ** 2]))
        assert got[1000 - i] == pytest.approx(want) if want is not None else got[1000 - i] is None
