from hypothesis import given
from hypothesis import strategies as st

from quernel.functions import codec
from quernel.operators import postings

IDS = st.lists(st.integers(0, 2**32 - 1), max_size=50)


def test_bytes():
    assert list(codec.encode_postings([7, 18, 19, 22, 25, 63])) == [6, 7, 11, 1, 3, 3, 38]
    assert codec.encode_varint(300) == b"\xac\x02" and codec.decode_varint(b"\xac\x02") == (300, 2)
    assert codec.decode_varint(b"") is None and codec.decode_varint(b"\x80") is None and codec.decode_varint(b"\x80" * 6) is None
    assert codec.encode_postings([]) == b"\x00" and codec.decode_postings(b"") == []


@given(IDS)
def test_roundtrip(ids):
    data = codec.encode_postings(ids)
    assert codec.decode_postings(data) == sorted(set(ids))
    assert codec.decode_postings(data[:-1]) == sorted(set(ids))[: len(codec.decode_postings(data[:-1]))]


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_algebra(spark):
    a = spark.createDataFrame([(x,) for x in (1, 3, 5, 7, 7)], "doc_id long")
    b = spark.createDataFrame([(x,) for x in (2, 3, 6, 7)], "doc_id long")
    assert ids(postings.intersect(a, b)) == [3, 7]
    assert ids(postings.union(a, b)) == [1, 2, 3, 5, 6, 7]
    assert ids(postings.subtract(a, b)) == [1, 5]


def test_many_and_packing(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2), (2, 70000), (3, None), (None, 5), (1, 70001)], "ngram_hash long, doc_id long")
    assert ids(postings.holding_all(rows, [1, 2])) == [2]
    assert ids(postings.holding_any(rows, [2, 9])) == [2, 70000]
    assert ids(postings.holding_all(rows, [])) == [] and ids(postings.holding_any(rows, [])) == []
    packed = postings.pack(rows)
    assert sorted((r["ngram_hash"], r["chunk"], r["doc_ids"]) for r in packed.collect()) == [(1, 0, [1, 2]), (1, 1, [70001]), (2, 0, [2]), (2, 1, [70000])]
    assert sorted(map(tuple, postings.document_frequency(packed).collect())) == [(1, 3), (2, 2)]


def test_delta_columns(spark):
    rows = spark.createDataFrame([(1, 7), (1, 18), (1, 19), (2, 5), (1, 7)], "ngram_hash long, doc_id long")
    d = codec.delta_encode(rows)
    assert sorted(map(tuple, d.collect())) == [(1, 7, 7), (1, 18, 11), (1, 19, 1), (2, 5, 5)]
    back = codec.delta_decode(d.withColumnRenamed("doc_id", "rank"))
    assert sorted((r["ngram_hash"], r["doc_id"]) for r in back.collect()) == [(1, 7), (1, 18), (1, 19), (2, 5)]


@given(st.lists(st.integers(0, 2**62), max_size=30))
def test_many_codes_at_once(values):
    import numpy as np

    data = codec.varints(np.array(values, np.int64))
    assert codec.from_varints(data).tolist() == values
    assert codec.from_varints(data[:-1]).tolist() == values[:-1]
    small = [v % (1 << 32) for v in values]
    assert codec.varints(np.array(small, np.int64)) == b"".join(map(codec.encode_varint, small))


def test_coded_lists(spark):
    ids = {1: [3, 5, 70_000, 200_000], 2: [0], 3: list(range(0, 140_000, 7))}
    rows = spark.createDataFrame([(k, d) for k, v in ids.items() for d in v], "ngram_hash long, doc_id long")
    coded = codec.encode_lists(postings.pack(rows))
    got = {k: [r["data"] for r in coded.where(f"ngram_hash = {k}").orderBy("chunk").collect()] for k in ids}
    for k, v in ids.items():
        assert codec.encode_varint(len(v)) + b"".join(map(bytes, got[k])) == codec.encode_postings(v)
    back = postings.unpack(codec.decode_lists(coded))
    assert sorted(map(tuple, back.collect())) == sorted((k, d) for k, v in ids.items() for d in v)
