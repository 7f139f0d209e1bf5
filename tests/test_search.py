import re

import pytest

from quernel.functions.trigrams import may_follow, may_precede, trigram_masks, trigrams
from quernel.operators import overlay
from quernel.operators.index import build, index_entries, merge, open_index
from quernel.operators.search import Searcher, formatted, ordered
from quernel.sources import corpus as C

TEXTS = {
    1: ("a/b.rs", b"fn main() {\n  foo();\n}\n"),
    2: ("a.txt", b"TODO: foobar\r\nFooBar\r\nend"),
    3: ("a/c.py", "def größe():\n    return Straße\n".encode()),
    4: ("empty", b""),
    5: ("two", b"fn"),
    6: ("bad", b"a\xffb fn \nfoo\r"),
    7: ("nl", b"\n\n"),
    8: ("kelvin", "5 \u212aelvin and ſize\n".encode()),
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(k, "", p, bytearray(c)) for k, (p, c) in TEXTS.items()], "doc_id long, root string, path string, content binary").repartition(3).cache()


@pytest.fixture(scope="module")
def searcher(corpus):
    return Searcher(corpus, build(corpus))


def brute(pattern, flags=0):
    out = []
    for k, (_, c) in TEXTS.items():
        lines = c.decode("utf-8", "replace").split("\n")
        lines = [x[:-1] if x.endswith("\r") and i < len(lines) - 1 else x for i, x in enumerate(lines)]
        if lines[-1] == "":
            lines.pop()
        out += [(k, i + 1, x) for i, x in enumerate(lines) if re.search(pattern, x, flags)]
    return sorted(out)


def got(df):
    return sorted((r["doc_id"], r["line_number"], r["line"]) for r in df.collect())


@pytest.mark.parametrize("pattern", ["foo", "fn main", "fn", "fo+", "foo|end", "^$", "", ".*", "nothing here", "größe|Straße", r"\s\w+\(", "[Ff]oo[Bb]ar", "a.b", "o$"])
@pytest.mark.parametrize("use_index", [True, False, None])
def test_lines(searcher, pattern, use_index):
    assert got(searcher.lines(pattern, use_index=use_index)) == brute(pattern)


@pytest.mark.parametrize("pattern", ["FOO", "kelvin", "SIZE", "GRÖSSE|grÖße", "straße"])
def test_ignore_case(searcher, pattern):
    want = brute(pattern, re.I)
    assert got(searcher.lines(pattern, ignore_case=True, use_index=True)) == want == got(searcher.lines(pattern, ignore_case=True, use_index=False))


def test_files_counts_filter(searcher):
    assert sorted(r["path"] for r in searcher.files("foo").collect()) == ["a.txt", "a/b.rs", "bad"]
    assert sorted((r["path"], r["n"]) for r in searcher.counts("(?i)foo").collect()) == [("a.txt", 2), ("a/b.rs", 1), ("bad", 1)]
    assert [r["path"] for r in searcher.lines("foo", path_filter=r"\.rs$").collect()] == ["a/b.rs"]
    assert searcher.exists("foo") and not searcher.exists("absent text")
    assert [r["path"] for r in ordered(searcher.files("foo")).collect()] == ["a/b.rs", "a.txt", "bad"]
    assert [r["result"] for r in formatted(searcher.lines("main"), True).collect()] == ["a/b.rs:1:fn main() {"]
    assert [r["result"] for r in formatted(searcher.counts("main")).collect()] == ["a/b.rs:1"]


def test_the_filter_reaches_the_scan(spark, corpus, tmp_path):
    build(corpus).save(str(tmp_path / "ix"), commit="abc ")
    index = open_index(spark, str(tmp_path / "ix"))
    assert index.commit == "abc" and index.stats().first()["file_count"] == 8
    plan = Searcher(corpus, index).evaluate(Searcher(corpus, index).plan("foobar"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(ngram_hash" in plan or "PushedFilters: [IsNotNull(ngram_hash), EqualTo(ngram_hash" in plan
    assert got(Searcher(corpus, index).lines("foobar", use_index=True)) == brute("foobar")
    with pytest.raises(FileNotFoundError):
        open_index(spark, str(tmp_path / "none"))


def test_index_is_the_same_for_any_partitioning(corpus):
    one = sorted(map(tuple, index_entries(corpus.coalesce(1)).collect()))
    assert one == sorted(map(tuple, index_entries(corpus.repartition(5)).collect())) and len(one) == len(set(one))


def test_empty_index(spark, corpus):
    none = corpus.where("false")
    index = build(none)
    assert index.stats().first().asDict() == {"file_count": 0, "ngram_count": 0, "posting_count": 0}
    assert Searcher(none, index).lines("foo").count() == 0


def test_merge_and_overlay(spark, corpus, searcher):
    after = spark.createDataFrame([(11, "", "a/b.rs", bytearray(b"foo two\n")), (2, "", "a.txt", bytearray(TEXTS[2][1])), (12, "", "new", bytearray(b"new foo\n"))], corpus.schema)
    before = corpus.where("doc_id in (1, 2, 6)")
    changes = overlay.detect_changes(before, after).cache()
    assert sorted((r["path"], r["status"]) for r in changes.collect()) == [("a/b.rs", "modified"), ("bad", "deleted"), ("new", "new")]
    fresh = overlay.refresh(build(before), after, changes)
    assert sorted(r["doc_id"] for r in Searcher(after, fresh).files("foo", use_index=True).collect()) == [2, 11, 12]
    lines = overlay.search_with_overlay(Searcher(before, build(before)), after, changes, "foo")
    assert sorted((r["path"], r["line"]) for r in lines.collect()) == [("a.txt", "TODO: foobar"), ("a/b.rs", "foo two"), ("new", "new foo")]
    results = spark.createDataFrame([(1,), (2,), (6,), (99,)], "doc_id long")
    assert sorted(r[0] for r in overlay.drop_stale(results, before, changes).collect()) == [2, 99]
    with pytest.raises(ValueError):
        merge(build(before), build(before, C.IndexConfig(max_ngram_length=8)))


def test_trigrams(spark):
    df = spark.createDataFrame([(1, bytearray(b"aba aba")), (2, bytearray(b"ab")), (3, None), (4, bytearray(b"the cat sat"))], "k long, b binary")
    found = {r["k"]: [bytes(x) for x in r["t"]] for r in df.select("k", trigrams(df["b"]).alias("t")).collect()}
    assert found[1] == [b"aba", b"ba ", b"a a", b" ab", b"aba"] and found[2] == [] and len(found[4]) == 9
    masks = {(r["k"], bytes(r["trigram"])): (r["loc_mask"], r["next_mask"]) for r in trigram_masks(df, "k", "b").collect()}
    import zlib

    assert masks[1, b"aba"] == (0x11, 1 << (zlib.crc32(b" ") & 255) % 8)
    pairs = spark.createDataFrame([(1 << i, 1 << (i + 1) % 8, 1 << i) for i in range(8)], "a int, b int, c int")
    assert pairs.where(may_follow(pairs["a"], pairs["b"])).count() == 8 and pairs.where(may_follow(pairs["a"], pairs["c"])).count() == 0
    from pyspark.sql import functions as F

    assert spark.range(1).select(may_precede(F.lit(4), F.lit(10)), may_precede(F.lit(4), F.lit(3))).first()[:] == (True, False)


def test_postings_of_any_ids(spark):
    from quernel.operators import postings
    from quernel.operators.index import index_postings

    ids = [5, 2**22 - 1, 2**22, 2**40 + 3, -7, 4, 2**23, 5]
    rows = [(k, "", "p", bytearray(f"text of number {k} and what all hold".encode())) for k in ids] + [(9, "", "p", None)]
    df = spark.createDataFrame(rows, "doc_id long, root string, path string, content binary").coalesce(1)
    want = sorted({tuple(r) for r in index_entries(df).collect()})
    assert sorted(map(tuple, postings.unpack(index_postings(df)).collect())) == want and len(want) > 100


@pytest.mark.parametrize(("local", "listed", "broadcast"), [(0, 5, 10), (0, 5, 0), (10**6, 0, 10), (10**6, 5, 10)])
@pytest.mark.parametrize("pattern", ["foo", "foo|end", "größe|Straße", "TODO.*foo", "nothing here"])
def test_every_way_to_the_candidates(corpus, searcher, monkeypatch, local, listed, broadcast, pattern):
    from quernel.operators import search

    monkeypatch.setattr(search, "LOCAL_POSTINGS", local)
    monkeypatch.setattr(search, "LISTED_IDS", listed)
    monkeypatch.setattr(search, "BROADCAST_IDS", broadcast)
    assert got(Searcher(corpus, searcher.index).lines(pattern, use_index=True)) == brute(pattern)


def test_id_ranges(spark):
    import numpy as np

    from quernel.operators.search import id_ranges

    ids = np.array([-9, -8, 1, 2, 3, 50, 1000, 1001, 2**40])
    every = spark.createDataFrame([(int(k),) for k in range(-20, 1100)] + [(2**40,), (2**40 + 1,)], "doc_id long")
    for most, want in ((1, None), (2, None), (5, set(ids.tolist())), (32, set(ids.tolist()))):
        found = {r[0] for r in every.where(id_ranges(ids, most)).collect()}
        assert found >= set(ids.tolist()) and (want is None or found == want)
    assert id_ranges(np.array([7])) == "doc_id between 7L and 7L"


def test_refresh_of_a_stored_index(spark, corpus, tmp_path):
    from quernel.operators.index import append, compact

    path = str(tmp_path / "ix")
    before = corpus.where("doc_id in (1, 2, 6)")
    build(before).save(path, commit="one", texts=before)
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "ix").rglob("*.parquet"))
    first = {f for f in (tmp_path / "ix").rglob("*.parquet")}
    after = spark.createDataFrame([(11, "", "a/b.rs", bytearray(b"foo two\n")), (2, "", "a.txt", bytearray(TEXTS[2][1])), (12, "", "new", bytearray(b"new foo\n"))], corpus.schema)
    assert overlay.refresh_stored(spark, path, after, overlay.detect_changes(before, after), commit="two") == 2
    later = spark.createDataFrame([(2, "", "a.txt", bytearray(TEXTS[2][1])), (12, "", "new", bytearray(b"new foo\n")), (13, "", "third", bytearray(b"foo third\n"))], corpus.schema)
    assert overlay.refresh_stored(spark, path, later, overlay.detect_changes(after, later)) == 3
    assert first <= set((tmp_path / "ix").rglob("*.parquet")) and size() > 0  # nothing old is written again
    index = open_index(spark, path)
    s = Searcher(index.texts, index)
    assert index.commit == "two" and sorted(r["doc_id"] for r in index.docs.collect()) == [2, 12, 13] == sorted(r["doc_id"] for r in index.texts.collect())
    assert sorted(r["line"] for r in s.lines("foo", use_index=True).collect()) == ["TODO: foobar", "foo third", "new foo"]
    assert sorted(r[0] for r in s.candidates("foo", use_index=True).collect()) == [2, 12, 13]
    whole = build(later)
    assert index.stats().first() == whole.stats().first() == compact(index).stats().first()
    index.save(str(tmp_path / "whole"))
    again = open_index(spark, str(tmp_path / "whole"))
    assert again.stale is None and again.texts is None and again.stats().first() == whole.stats().first()
    with pytest.raises(ValueError):
        append(spark, path, whole, before.select("doc_id"))  # its texts are missing
    with pytest.raises(ValueError):
        append(spark, path, build(later, C.IndexConfig(max_ngram_length=8)), before.select("doc_id"), texts=later)
    with pytest.raises(FileNotFoundError):
        append(spark, str(tmp_path / "none"), whole, before.select("doc_id"))


def test_the_scan_reads_no_more_than_candidates(spark, tmp_path):
    rows = [(k, "", f"p{k}", bytearray((f"common words {'special phrase' if k % 1000 == 7 else ''} {k}\n" * 20).encode())) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, root string, path string, content binary")
    build(docs).save(str(tmp_path / "ix"), texts=docs)
    index = open_index(spark, str(tmp_path / "ix"))
    hits = Searcher(index.texts, index).files("special phrase")
    assert sorted(r["doc_id"] for r in hits.collect()) == [7, 1007, 2007, 3007]
    plan = hits._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "PushedFilters: [" in plan and "And(GreaterThanOrEqual(doc_id" in plan
