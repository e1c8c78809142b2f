"""Intervals against spelled-out positions."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluate, spread, windows
from tidewatch.sources import readers

BY = ["g"]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(9)
    lengths = {"a": 60, "b": 200, "c": 7}
    points = [(g, t, "k") for g, n in lengths.items() for t in range(n)] + [(None, 3, "k"), ("a", None, "k")]
    segs = []
    for g, n in lengths.items():
        for i in range(12):
            s = r.randint(-5, n + 5)
            segs.append((g, i, s, s + r.randint(-1, 9)))
    segs += [("c", 50, 2, 10**12), ("gone", 1, 0, 5), (None, 2, 0, 9), ("b", 60, 199, 199)]
    return (
        lengths, points, segs, spark.createDataFrame(points, "g string, t long, y string").repartition(3),
        spark.createDataFrame(segs, "g string, seg_id int, start_t long, end_t long"),
        spark.createDataFrame(list(lengths.items()), "g string, n long"),
    )


@pytest.mark.parametrize("size", [None, 8])
def test_paint(tables, size):
    _, points, segs, df, s, _ = tables
    got = windows.paint_segments(df, s, BY, size=size)
    assert got.columns == ["g", "t", "y"]
    rows = sorted(map(tuple, got.collect()), key=str)
    inside = lambda g, t: int(any(g is not None and t is not None and g == x[0] and x[2] <= t <= x[3] for x in segs))
    assert rows == sorted(((g, t, inside(g, t)) for g, t, _ in points), key=str)
    assert windows.paint_segments(df.limit(0), s, BY).count() == 0
    assert {r.y for r in windows.paint_segments(df, s.limit(0), BY).collect()} == {0}


@pytest.mark.parametrize("size", [None, 8])
def test_cover(spark, tables, size):
    lengths, _, _, _, _, n = tables
    r = random.Random(4)
    flagged = [(g, r.randint(0, lengths[g] + 3)) for g in "abc" for _ in range(9)] + [("a", 5), ("a", 5), ("gone", 1)]
    for length in (1, 2, 7, 30):
        got = windows.window_cover(spark.createDataFrame(flagged, "g string, w long"), n, BY, length, size)
        rows = [tuple(r) for r in got.collect()]
        want = {(g, t) for g, w in flagged if g in lengths for t in range(w, min(w + length, lengths[g]))}
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_detected(spark, tables):
    lengths, _, segs, _, s, n = tables
    r = random.Random(2)
    cover = {(g, r.randrange(lengths[g])) for g in "abc" for _ in range(4)}
    got = evaluate.segments_detected(s, spark.createDataFrame(list(cover), "g string, t long"), n, BY)
    rows = sorted((tuple(x) for x in got.collect()), key=str)
    hit = lambda x: int(any(g == x[0] and max(x[2], 0) <= t <= min(x[3], lengths[g] - 1) for g, t in cover))
    assert rows == sorted(((*x, hit(x)) for x in segs), key=str)


def test_an_interval_of_a_billion_steps(spark):
    segs = spark.createDataFrame([("a", 0, 5, 10**9)], "g string, seg_id int, start_t long, end_t long")
    df = spark.range(20).select(F.lit("a").alias("g"), (F.col("id") * 10**8).alias("t"))
    assert [r.y for r in windows.paint_segments(df, segs, BY).orderBy("t").collect()] == [0] + [1] * 10 + [0] * 9
    ends = windows.paint_segments(df, segs, BY)._jdf.queryExecution().toString()
    assert "sequence" not in ends
    cover = df.where("t = 700000000")
    n = spark.createDataFrame([("a", 2 * 10**9)], "g string, n long")
    assert evaluate.segments_detected(segs, cover, n, BY).first().detected == 1


def test_file_ranks_follow_names_with_odd_signs(spark, tmp_path):
    folder = tmp_path / "odd ä %20 names"
    folder.mkdir()
    for name in ("part 10.csv", "part 9.csv", "pärt+1.csv", "a%b.csv"):
        (folder / name).write_text("x\n1\n")
    scan = spark.read.csv(str(folder), header=True)
    placed = readers.with_place(scan)
    both = spread.lookup_join(placed, readers.file_ranks(scan), ["_file"], "left").orderBy("_rank").collect()
    assert len(both) == 4 and all(r["_rank"] for r in both)
    names = [r["_file"].rsplit("/", 1)[1] for r in both]
    assert [n for n in names if "part" in n] == sorted((n for n in names if "part" in n), key=lambda n: "10" in n)
