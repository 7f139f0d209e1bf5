import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.functions import ngrams, weights

VECTORS = {
    "abcdef": ["abc", "bcde", "def"],
    "foo": ["foo"],
    "fn main": ["fn ma", "main"],
    "mutex_lock": ["mutex_", "x_l", "_lock"],
    "max_file_size": ["max_", "x_file_size"],
    "hello world": ["hello wo", "world"],
}


def brute(data: bytes, longest: int = 16) -> set:
    w = [weights.pair_weight(a, b) for a, b in zip(data, data[1:])]
    found = set()
    for left in range(len(w)):
        for right in range(left + 1, len(w)):
            inner = w[left + 1 : right]
            if right + 2 - left <= longest and max(inner, default=-1) < min(w[left], w[right]):
                found.add((left, data[left : right + 2]))
    return found


def test_ranks():
    r = weights.RANKS
    assert len(r) == 256 and set(r[128:].tolist()) == {200}
    assert [int(r[ord(c)]) for c in " etaoins"] == list(range(8))
    assert weights.pair_weight(ord("q"), ord("z")) > weights.pair_weight(ord("t"), ord("h"))


@pytest.mark.parametrize("text", VECTORS)
def test_covering_vectors(text):
    assert [g.decode() for g in ngrams.covering_ngrams(text.encode())] == VECTORS[text]


def test_small_inputs():
    assert ngrams.sparse_ngrams(b"") == [] and ngrams.sparse_ngrams(b"a") == []
    assert ngrams.sparse_ngrams(b"ab") == [(0, b"ab")]
    assert ngrams.sparse_ngrams(b"abc") == [(0, b"abc")]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text(alphabet="abq_ \n", max_size=60).map(str.encode)))
def test_closed_form_is_the_definition(data):
    if len(data) >= 3:
        assert set(ngrams.sparse_ngrams(data)) == brute(data)
        assert len(ngrams.sparse_ngrams(data, len(data))) <= 2 * max(len(data) - 2, 1)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=3, max_size=40), st.binary(max_size=20), st.binary(max_size=20))
def test_literal_ngrams_are_in_every_text(literal, before, after):
    whole = {g for _, g in ngrams.sparse_ngrams(before + literal + after)}
    cover = ngrams.covering_ngrams(literal)
    assert cover and set(cover) <= whole


def test_hashes_over_many_texts():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcxyz_ \n") for _ in range(rng.randint(0, 50))) for _ in range(40)]
    size = np.array([len(t) for t in texts])
    stop = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)
    start, length, code = ngrams.hashes(np.frombuffer(b"".join(texts), np.uint8), stop[owner])
    got = sorted((int(owner[s]), int(s - (stop - size)[owner[s]]), int(n), int(c)) for s, n, c in zip(start, length, code))
    want = sorted((i, p, len(g), zlib.crc32(g)) for i, t in enumerate(texts) if len(t) != 2 for p, g in ngrams.sparse_ngrams(t))
    assert got == want


def test_fold():
    assert ngrams.fold("ÀBC KſZ".encode()) == "Àbc ksz".encode()


def test_table_of_hashes_agrees_with_the_kernel(spark, data):
    """The given entries were cut down to some hashes; each that stands there must come out."""
    from quernel.operators.index import index_entries
    from quernel.sources.corpus import from_table

    given_rows = spark.read.parquet(f"{data}/ngram_entry.parquet").where("doc_id is not null and pos is not null").distinct()
    files = spark.read.parquet(f"{data}/corpus_file.parquet").dropDuplicates(["doc_id"]).where("content is not null")
    entries = index_entries(from_table(files, "doc_id", "path", "content"), distinct=False)
    both = given_rows.join(files.select("doc_id"), "doc_id", "left_semi")
    assert both.count() > 1000
    assert both.join(entries, ["ngram_hash", "doc_id", "pos"], "left_anti").count() <= 0.01 * both.count()


def test_packed_numbers():
    from quernel.functions.ngrams import pack_numbers, unpack_numbers

    for a, b in (([], []), ([0], [2**32 - 1]), (list(range(0, 70_000, 3)), [7] * len(range(0, 70_000, 3)))):
        got = unpack_numbers(pack_numbers(np.array(a, np.uint32), np.array(b, np.int64)), 2)
        assert [x.tolist() for x in got] == [a, b]
