"""Continuous indexing: each micro-batch of documents is indexed and appended in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quernel.operators.incremental import Target
from quernel.operators.index import index_entries
from quernel.sources.corpus import IndexConfig


def index_stream(documents: DataFrame, path: str, checkpoint: str, config: IndexConfig = IndexConfig()) -> StreamingQuery:
    """Index a stream (doc_id, content) into the versioned table of entries at ``path``.

    Each version's name carries its micro-batch's number; a batch that is run again after a failure
    finds its number among the committed ones and is passed over, so every batch is indexed exactly once.
    """

    def one(batch: DataFrame, number: int) -> None:
        target = Target(batch.sparkSession, path)
        if not target.has(f"batch{number}"):
            target.publish(index_entries(batch, config), label=f"batch{number}")

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed_entries(spark, path: str) -> DataFrame:
    """(ngram_hash, doc_id) of all committed batches."""
    rows = Target(spark, path).read()
    return spark.createDataFrame([], "ngram_hash long, doc_id long") if rows is None else rows.select("ngram_hash", "doc_id")
