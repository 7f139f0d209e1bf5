"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from quernel.plans import core_queries, search_queries

duckdb = pytest.importorskip("duckdb")
QUERIES = search_queries.QUERIES | core_queries.QUERIES
SQL = search_queries.SQL | core_queries.SQL


def plain(value):
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name not in SQL:
        assert rows is not None and df.columns
        return
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in rows)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "path", "line_number", "line"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_index_of_all_documents_against_brute_force(spark, data):
    """Positions and statistics of the sparse n-grams of whole documents, whose SQL would be too slow."""
    import zlib

    from quernel.functions import weights

    places, pairs, docs = {}, set(), set()
    for r in {tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}:
        if r[0] is None:
            continue
        docs.add(r[0])
        text = "".join(c.lower() if c.isascii() else {"K": "k", "ſ": "s"}.get(c, c) for c in r[1] or "").encode()
        w = [weights.pair_weight(a, b) for a, b in zip(text, text[1:])]
        found = [(i, text[i : j + 2]) for i in range(len(w)) for j in range(i + 1, min(i + 15, len(w))) if max(w[i + 1 : j], default=-1) < min(w[i], w[j])]
        if found:
            places[r[0]] = (len(found), sum(i for i, _ in found))
            pairs |= {(zlib.crc32(g), r[0]) for _, g in found}
    got = {r["doc_id"]: (r["n_entries"], r["sum_pos"]) for r in QUERIES["ngram_positions"](spark, data).collect()}
    assert len(got) > 50 and got == places
    assert [tuple(r) for r in QUERIES["index_stats_documents"](spark, data).collect()] == [(len(docs), len({h for h, _ in pairs}), len(pairs))]
