import random
from itertools import groupby

import pytest

from quernel.operators import skew


def brute(rows):
    """Folds rows given in stored order."""
    out = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        pos = [r[2] for r in mine if r[2] is not None]
        out[k] = (len(mine), sum(r[1] is not None for r in mine), len(list(groupby(r[1] for r in mine))), mine[0][1], mine[-1][1], min(pos, default=None), max(pos, default=None), sum(pos) if pos else None)
    return out


FIELDS = ("n_rows", "n_values", "n_runs", "first_value", "last_value", "min_measure", "max_measure", "sum_measure")


def folded(df, **options):
    return {r["key"]: tuple(r[f] for f in FIELDS) for r in skew.fold_by_key(df, "k", "v", "m", **options).collect()}


def data(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 1, 2, 3, None, *range(4, 40)]), rng.choice([1, 2, 2, 2, None]), rng.choice([None, *range(20)])) for _ in range(n)]


@pytest.mark.parametrize("chunk", [None, 1, 7, 64])
@pytest.mark.parametrize("bound", [10**6, 0])
def test_against_brute_force(spark, table, chunk, bound):
    df = table(data(3000), "k long, v long, m int", files=5)
    stored = [tuple(r) for r in df.collect()]  # the order of partitions
    assert folded(df, chunk_rows=chunk, broadcast_offsets=bound) == brute(stored)


def test_buffers_within_a_partition(table, monkeypatch):
    monkeypatch.setattr(skew, "BUFFER_ROWS", 50)
    df = table(data(1000, 2), "k long, v long, m int")
    assert folded(df, chunk_rows=10) == brute([tuple(r) for r in df.collect()])


def test_strings_clashing_columns_and_unstable_input(spark):
    rows = [("x", "a", 1, "u"), ("x", "a", 2, "u"), ("y", None, None, "u"), ("x", "b", 3, "u")]
    df = spark.createDataFrame(rows, "k string, v string, m int, n_rows string").withColumn("part", df_lit()).repartition(3).distinct()
    got = folded(df, chunk_rows=1)
    assert got["y"] == (1, 0, 1, None, None, None, None, None) and got["x"][0] == 3 and got["x"][5:] == (1, 3, 6)


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("z")


def test_chunks_and_hot_keys(table):
    df = table([(1, 5, 0)] * 90 + [(k, 5, 0) for k in range(2, 12)] + [(None, 5, 0)] * 20, "k long, v long, m int", files=3)
    out = skew.fold_by_key(df, "k", "v", chunk_rows=16)
    assert {r["key"]: r["n_chunks"] for r in out.collect()}[1] == 6
    assert [tuple(r) for r in skew.hot_keys(out, 0.02).collect()] == [(1, 90)]


def test_empty(table):
    assert folded(table([], "k long, v long, m int")) == {}
