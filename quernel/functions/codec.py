"""Variable-length integers and delta-coded posting lists, for exchange with other tools.

The index itself is Parquet, whose encodings do this job; these are for reading and writing the
compact byte form: a count, then each id's difference to the one before, seven bits to a byte,
low bits first, the high bit marking that more follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.operators.postings import CHUNK, pack


def encode_varint(value: int) -> bytes:
    if not 0 <= value < 1 << 32:
        raise ValueError("a 32-bit unsigned integer is needed")
    digits = []
    while True:
        value, low = value >> 7, value & 127
        digits.append(low | (128 if value else 0))
        if not value:
            return bytes(digits)


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(value, next position); null if the bytes end early or are more than five."""
    for n in range(1, 6):
        piece = data[at : at + n]
        if len(piece) < n:
            return None
        if piece[-1] < 128:
            return sum((b & 127) << 7 * k for k, b in enumerate(piece)), at + n
    return None


def encode_postings(ids: list[int]) -> bytes:
    """Sorts, removes repeats and encodes."""
    ordered = sorted(set(ids))
    gaps = [b - a for a, b in zip([0, *ordered[:-1]], ordered)]
    return b"".join(map(encode_varint, [len(ordered), *gaps]))


def decode_postings(data: bytes) -> list[int]:
    """The ids; what is there of a list that breaks off."""
    head = decode_varint(data)
    out: list[int] = []
    if head is None:
        return out
    count, at = head
    while len(out) < count and (step := decode_varint(data, at)) is not None:
        out.append((out[-1] if out else 0) + step[0])
        at = step[1]
    return out


def varints(values: np.ndarray) -> bytes:
    """The codes of many integers, one after the other."""
    x = values.astype(np.uint64)
    n = np.ones(len(x), np.int64)
    for k in range(1, 10):
        n += x >= np.uint64(1 << 7 * k)
    place = np.arange(n.max(initial=1))
    digits = (x[:, None] >> (7 * place).astype(np.uint64)).astype(np.uint8) & 127
    digits |= np.where(place < (n - 1)[:, None], 128, 0).astype(np.uint8)
    return digits[place < n[:, None]].tobytes()


def from_varints(data: bytes) -> np.ndarray:
    """The integers of a sequence of codes; a code that breaks off is left out."""
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(b < 128)
    if not len(end):
        return np.zeros(0, np.int64)
    b = b[: end[-1] + 1].astype(np.uint64)
    start = np.r_[0, end[:-1] + 1]
    within = np.arange(len(b)) - np.repeat(start, end - start + 1)
    return np.add.reduceat((b & np.uint64(127)) << (7 * within).astype(np.uint64), start).astype(np.int64)


def encode_lists(packed: DataFrame, key: str = "ngram_hash") -> DataFrame:
    """(key, chunk, n_docs, data): each range of a posting list as codes of its ids' differences.

    A range's first id is compared with the last of the range before it, so that the code of a whole
    list is its length's and then its ranges' in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x.values.to_numpy(zero_copy_only=False) for x in b.column("doc_ids")]
            data = [varints(np.diff(ids, prepend=before)) for ids, before in zip(lists, b.column("before").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), b.column("n_docs"), pa.array(data, pa.binary())], names=["key", "chunk", "n_docs", "data"])

    before = F.lag(F.element_at("doc_ids", -1), 1, 0).over(W.partitionBy(key).orderBy("chunk"))  # a row per range
    rows = packed.select(F.col(key).alias("key"), "chunk", "n_docs", "doc_ids", before.alias("before"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, chunk long, n_docs int, data binary").withColumnRenamed("key", key)


def decode_lists(coded: DataFrame, key: str = "ngram_hash") -> DataFrame:
    """(key, chunk, doc_ids) of the result of ``encode_lists``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gaps = [from_varints(d) for d in b.column("data").to_pylist()]
            sums = pa.array([int(g.sum()) for g in gaps], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), sums, pa.array([np.cumsum(g) for g in gaps], pa.list_(pa.int64()))], names=["key", "chunk", "total", "sums"])

    rows = coded.select(F.col(key).alias("key"), "chunk", "data")
    sums = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, chunk long, total long, sums array<long>")
    start = F.coalesce(F.sum("total").over(W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.select("key", "chunk", "sums", start.alias("start")).select(F.col("key").alias(key), "chunk", F.transform("sums", lambda x: x + F.col("start")).alias("doc_ids"))


def delta_encode(postings: DataFrame, key: str = "ngram_hash", doc: str = "doc_id") -> DataFrame:
    """(key, doc, delta): each id's difference to the one before in its list.

    A list is cut into aligned ranges of ids; differences are taken within a range, and a range's
    first id is compared with the last of the range before it. No task holds a whole list.
    """
    lists = pack(postings, key, doc)
    before = F.lag(F.element_at("doc_ids", -1), 1, 0).over(W.partitionBy(key).orderBy("chunk"))  # a row per range
    ids = lists.select(key, "doc_ids", F.concat(F.array(before), F.slice("doc_ids", F.lit(1), F.size("doc_ids") - 1)).alias("previous"))
    pairs = ids.select(key, F.explode(F.arrays_zip("doc_ids", "previous")).alias("x"))
    return pairs.select(key, F.col("x.doc_ids").alias(doc), (F.col("x.doc_ids") - F.col("x.previous")).alias("delta"))


def delta_decode(deltas: DataFrame, key: str = "ngram_hash", order: str = "rank") -> DataFrame:
    """(key, order, doc_id) from rows (key, order, delta) with an integer order: the running sum.

    Sums run within aligned ranges of the order; each range starts from the total of those before it.
    """
    rows = deltas.select(key, order, "delta", F.floor(F.col(order) / CHUNK).alias("part"))
    by_part = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(key, "part").agg(F.sum("delta").alias("total")).select(key, "part", F.coalesce(F.sum("total").over(by_part), F.lit(0)).alias("start"))
    within = W.partitionBy(key, "part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(starts, [key, "part"]).select(key, order, (F.col("start") + F.sum("delta").over(within)).alias("doc_id"))
