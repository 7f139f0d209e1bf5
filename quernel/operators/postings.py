"""Set algebra on posting lists, as rows or as arrays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids per row of a stored posting list: a row holds the ids of one aligned range of this size.
CHUNK = 1 << 16


def pack(entries: DataFrame, key: str = "ngram_hash", doc: str = "doc_id") -> DataFrame:
    """(key, chunk, n_docs, doc_ids): sorted distinct ids of each key in ranges of ``CHUNK`` ids.

    No row holds more than ``CHUNK`` ids and no task a whole list, however frequent the key.
    """
    rows = entries.where(F.col(key).isNotNull() & F.col(doc).isNotNull())
    lists = rows.groupBy(key, F.floor(F.col(doc) / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_set(doc)).alias("doc_ids"))
    return lists.select(key, "chunk", F.size("doc_ids").alias("n_docs"), "doc_ids")


def unpack(postings: DataFrame, key: str = "ngram_hash") -> DataFrame:
    return postings.select(key, F.explode("doc_ids").alias("doc_id"))


def document_frequency(postings: DataFrame, key: str = "ngram_hash") -> DataFrame:
    return postings.groupBy(key).agg(F.sum("n_docs").cast("long").alias("df"))


def intersect(a: DataFrame, b: DataFrame, doc: str = "doc_id") -> DataFrame:
    return a.select(doc).intersect(b.select(doc))


def union(a: DataFrame, b: DataFrame, doc: str = "doc_id") -> DataFrame:
    return a.select(doc).union(b.select(doc)).distinct()


def subtract(a: DataFrame, b: DataFrame, doc: str = "doc_id") -> DataFrame:
    return a.select(doc).subtract(b.select(doc))


def holding_all(entries: DataFrame, keys: Iterable, key: str = "ngram_hash", doc: str = "doc_id") -> DataFrame:
    """Ids that stand in the lists of all keys; of no keys at all: none."""
    wanted = sorted(set(keys))
    if not wanted:
        return entries.select(doc).where("false")
    rows = entries.where(F.col(key).isin(wanted)).select(key, doc).distinct()
    return rows.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select(doc)


def holding_any(entries: DataFrame, keys: Iterable, key: str = "ngram_hash", doc: str = "doc_id") -> DataFrame:
    wanted = sorted(set(keys))
    return entries.where(F.col(key).isin(wanted) if wanted else F.lit(False)).select(doc).distinct()


def array_intersect_many(arrays: list[Column]) -> Column:
    if not arrays:
        return F.array().cast("array<bigint>")
    out = arrays[0]
    for a in arrays[1:]:
        out = F.array_intersect(out, a)
    return F.array_sort(F.array_distinct(out))
