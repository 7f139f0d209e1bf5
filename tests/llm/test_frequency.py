import random

import pytest

from quernel.llm import frequency as Q


def brute(rows):
    ok = [r for r in rows if r[0] is not None and r[1] is not None]
    docs = {r[1] for r in rows if r[1] is not None}
    return {t: (len({(r[1], r[2]) for r in ok if r[0] == t}), len({r[1] for r in ok if r[0] == t}), len(docs)) for t in {r[0] for r in ok}}


def counted(df, *cols, **options):
    rows = Q.term_frequencies(df, *cols, **options).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(rows)))
    return {r["term"]: (r["occurrences"], r["records"], r["n_records"]) for r in rows}


def data(n, seed=0):
    rng = random.Random(seed)
    return [(rng.choice([7, 7, 7, None, *range(100, 160)]), rng.choice([None, 1, 1, 1, *range(2, 30)]), rng.choice([None, 0, 1, 2, 3])) for _ in range(n)]


@pytest.mark.parametrize("piece", [10, 4_000_000])
def test_against_brute_force(table, piece):
    rows = data(3000)
    assert counted(table(rows, "t long, d long, p int", files=4), "t", "d", "p", piece_rows=piece) == brute(rows)


@pytest.mark.parametrize("hot", [0, 5, 10**9])
def test_many_ranges_and_hot_terms(table, monkeypatch, hot):
    """No term is hot, one with a third of all rows is, or all are."""
    monkeypatch.setattr(Q, "RANGE", 8)
    monkeypatch.setattr(Q, "HOT", hot)
    monkeypatch.setattr(Q, "BUFFER_ROWS", 200)
    rows = data(2000, 1)
    assert counted(table(rows, "t long, d long, p int", files=3), "t", "d", "p", piece_rows=50) == brute(rows)
    monkeypatch.setattr(Q, "MAX_RANGES", 2)
    assert counted(table(rows, "t long, d long, p int", files=3), "t", "d", "p", piece_rows=50) == brute(rows)


def test_strings_clashing_columns_and_no_position(table):
    rows = [("a", "x", 1, 5), ("a", "x", 1, 6), ("a", "y", None, 7), ("", "y", 1, 8), (None, "z", 1, 9), ("b" * 100_000, "x", 1, 9)]
    df = table(rows, "term string, record string, id int, n_rows int", files=2)
    got = counted(df, "term", "record")
    assert got == {"a": (2, 2, 3), "": (1, 1, 3), "b" * 100_000: (1, 1, 3)}


def test_marks(table):
    df = table([(1, d, 0) for d in range(8)] + [(2, 1, 0), (3, 1, 0), (3, 2, 0)], "t long, d long, p int")
    freq = Q.term_frequencies(df, "t", "d", "p")
    assert {r["term"]: r["m"] for r in freq.select("term", Q.mark(freq).alias("m")).collect()} == {1: "common", 2: "rare", 3: None}


def test_empty(table):
    assert counted(table([], "t long, d long, p int"), "t", "d", "p") == {}
    assert counted(table([(None, 1, 1), (1, None, 1)], "t long, d long, p int"), "t", "d", "p") == {}
