"""Cuts are exact, both size routes agree on odd values, and no series is lost."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluate, prepare, scoring, spread, windows

BY = ["g"]
ODD = "g string, t long, x double"


@pytest.fixture(scope="module")
def odd(spark):
    values = [None, float("nan"), 0.0, -0.0, 0.0, None, 3.5, 3.5, -1.0, float("nan")]
    rows = [("a", i, v) for i, v in enumerate(values)] + [(None, i, v) for i, v in enumerate(values[2:])]
    rows += [("none", i, None) for i in range(4)] + [("one", 0, 2.0)]
    return spark.createDataFrame(rows, ODD)


def rows(df):
    return sorted(map(str, df.collect()))


def test_trim_keeps_losses_that_lie_close(spark):
    df = spark.createDataFrame([("a", i, 0.1234567891 + i * 1e-12) for i in range(100)], ODD)
    for limit in (None, 1):
        kept = {r.t for r in scoring.trim(df, BY, "x", limit=limit).collect()}
        assert kept == set(range(1, 99))


def test_flag_tiny_scores(spark):
    df = spark.createDataFrame([("a", i, i * 1e-11) for i in range(100)], "g string, t long, score double")
    flagged = scoring.flag(df, scoring.fit_threshold(df, BY, 95.0), BY)
    assert {r.t for r in flagged.where("pred = 1").collect()} == {95, 96, 97, 98, 99}
    swept = evaluate.threshold_sweep(df.withColumn("y", F.lit(1)), BY, [95.0]).first()
    assert swept.n_detected == 5


@pytest.mark.parametrize("by", [BY, []])
def test_percentile_routes_agree_on_odd_values(odd, by):
    points = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    small = spread.percentiles(odd, by, "x", points)
    large = spread.percentiles(odd, by, "x", points, limit=1)
    columns = [*by, "q"]
    plain = lambda df: rows(df.select(*by, F.transform("q", lambda v: v + 0.0).alias("q")))
    got = {r[0] if by else None: r["q"] for r in large.select(columns).collect()}
    assert len(got) == (4 if by else 1)
    if by:
        assert got["none"] is None or all(v is None for v in got["none"])
        small, large = small.where("g != 'none'"), large.where("g != 'none'")
    assert plain(small) == plain(large)


def test_rank_routes_agree_on_odd_values(odd):
    small, large = windows.average_rank(odd, BY, "x"), windows.average_rank(odd, BY, "x", limit=1)
    assert rows(small) == rows(large) and small.count() == odd.count()


def test_series_without_a_fit_are_kept(spark, odd):
    fitted = spark.createDataFrame([("a", 1.0)], "g string, threshold double")
    flagged = scoring.flag(odd.withColumnRenamed("x", "score"), fitted, BY)
    assert flagged.count() == odd.count() and flagged.where("g = 'one'").first().pred is None
    assert {r.g: r.n for r in scoring.unfitted(flagged, BY).collect()} == {None: 8, "none": 4, "one": 1}
    stats = spark.createDataFrame([("a", 0.0, 1.0)], "g string, mean_x double, std_x double")
    assert prepare.scale_standard(odd, stats, BY, ["x"]).count() == odd.count()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_routes_agree_with_maps_and_null_keys(spark, how):
    df = spark.createDataFrame([("a", 1, {"k": 1.0}), (None, 2, {}), ("b", 3, None)], "g string, i int, params map<string,double>")
    small = spark.createDataFrame([("a", 10), (None, 20)], "g string, v int")
    assert rows(spread.lookup_join(df, small, BY, how)) == rows(spread.lookup_join(df, small, BY, how, limit=0))
    assert spread.lookup_join(df, small, BY, how).count() == {"inner": 2, "left": 3, "left_semi": 2, "left_anti": 1}[how]


def test_grown_table_is_counted_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 0, 1.0)], ODD).write.parquet(path)
    assert not spread.has_hot_group(spark.read.parquet(path), BY, 2)
    spark.createDataFrame([("a", i, 1.0) for i in range(5)], ODD).write.mode("append").parquet(path)
    assert spread.has_hot_group(spark.read.parquet(path), BY, 2)


class Cluster:
    """A session whose master is not local and that has no shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

        @staticmethod
        def getCheckpointDir():
            return None

    conf = {}


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        spread.shared_dir(Cluster)


def test_job_removes_what_it_stored(spark, odd):
    with spread.job(spark) as keep:
        kept = spread.durable(odd)
        at = kept.inputFiles()[0]
        result = keep(kept.where("g = 'a'"))
    assert result.count() == 10
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
