from quernel.operators.index import index_entries
from quernel.streaming.delta_index import index_stream, indexed_entries


def test_each_batch_once(spark, tmp_path):
    rows = [(1, bytearray(b"hello world")), (2, bytearray(b"foo bar")), (3, bytearray(b""))]
    docs = spark.createDataFrame(rows, "doc_id long, content binary")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.where("doc_id < 3").write.parquet(source)
    start = lambda offsets: index_stream(spark.readStream.schema(docs.schema).parquet(source), out, str(tmp_path / offsets)).awaitTermination()
    start("a")
    docs.where("doc_id = 3").write.mode("append").parquet(source)
    start("a")
    want = sorted(map(tuple, index_entries(docs).collect()))
    assert sorted(map(tuple, indexed_entries(spark, out).collect())) == want
    start("lost")  # the offsets were lost: batch 0 comes again and is passed over
    assert sorted(map(tuple, indexed_entries(spark, out).collect())) == want
