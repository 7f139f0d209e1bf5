import os

import pytest
from pyspark.sql import functions as F

from quernel.operators import incremental as I

KEEP = lambda new: new.select(I.KEY, I.VERSION)


def keys(df):
    return sorted(r[I.KEY] for r in df.collect())


def source(spark, rows):
    return spark.createDataFrame(rows, "id long, at int, source_key string")


def test_new_and_changed_only(spark, tmp_path):
    t = I.Target(spark, str(tmp_path / "t"))
    assert t.read() is None
    s = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "id long, at int")
    assert I.run_incremental(s, t, "id", "at", KEEP)[0] == 1
    assert keys(I.run_incremental(s, t, "id", "at", KEEP)[1]) == []
    more = s.unionByName(spark.createDataFrame([(2, 2), (4, 1)], "id long, at int"))
    assert keys(I.run_incremental(more, t, "id", "at", KEEP)[1]) == [2, 4]
    assert keys(t.read()) == [1, 2, 2, 3, 4] and [n for n, _ in t.versions()] == [1, 2, 3]


def test_failed_run_leaves_nothing(spark, tmp_path):
    t = I.Target(spark, str(tmp_path / "t"))
    s = spark.createDataFrame([(1, 1)], "id long, at int")
    I.run_incremental(s, t, "id", "at", KEEP)
    both = s.unionByName(spark.createDataFrame([(2, 1)], "id long, at int"))

    def broken(new):
        return KEEP(new).withColumn("x", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        I.run_incremental(both, t, "id", "at", broken)
    assert keys(t.read()) == [1]
    # written, but the run ended before the marker came
    KEEP(both.withColumn(I.KEY, F.col("id")).withColumn(I.VERSION, F.col("at"))).write.parquet(str(tmp_path / "t" / "v000000002-dead"))
    assert keys(t.read()) == [1]
    assert keys(I.run_incremental(both, t, "id", "at", KEEP)[1]) == [2]
    assert t.vacuum() >= 1 and keys(t.read()) == [1, 2]


def test_racing_runs(spark, tmp_path):
    t = I.Target(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, 1)], f"{I.KEY} long, {I.VERSION} int")
    t.publish(rows, 0)
    with pytest.raises(FileExistsError):
        t.publish(rows, 0)
    os.makedirs(tmp_path / "t" / "late")
    store = t.store
    store.list = lambda: []  # a run that has not seen version 1
    with pytest.raises(FileExistsError):
        store.commit("late")


def test_first_seen_and_last_success(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, None, "z"), (None, 1, "n"), (1, 3, "y")], "id long, at int, source_version string")
    assert sorted(map(tuple, I.first_seen(df, "id", "at").collect())) == [(1, 3), (2, None)]
    runs = spark.createDataFrame([(1, 5, True), (1, 9, False), (1, 7, True), (2, 1, False), (None, 3, True)], "root int, started int, ok boolean")
    assert [tuple(r) for r in I.last_success(runs, "root", "started", F.col("ok")).collect()] == [(1, 7)]


def test_replay_then_run(spark, tmp_path):
    changes = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 2, 5), (4, 1, None), (5, None, 1)], "id long, root int, at int")
    runs = spark.createDataFrame([(1, 15, True), (1, 30, False)], "root int, started int, ok boolean")
    t = I.replay(spark, changes, runs, str(tmp_path / "t"), "id", "root", "at", "started", F.col("ok"))
    assert keys(t.read()) == [1]
    assert keys(I.run_incremental(changes, t, "id", "at", KEEP)[1]) == [2, 3, 4, 5]


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, at int")
    assert keys(I.run_incremental(none, I.Target(spark, str(tmp_path / "t")), "id", "at", KEEP)[1]) == []
