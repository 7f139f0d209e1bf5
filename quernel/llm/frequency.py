"""Frequency of every distinct term: occurrences, records that hold it, and rare or common marks.

1. A global integer dictionary: the distinct terms are spread over hash buckets, ranked within
   their bucket and shifted by the bucket's base, so that the ids are dense.
2. The rows are encoded by it and packed, block of rows by block of rows, into pieces. A piece
   holds the (id, record, position) triples of one identifier range and one salt of the record.
   Ranges with many rows get as many salts as they need, so a term with a third of all rows is
   spread over many tasks, and repeated rows still meet in one place.
3. Each task turns its pieces into dense count arrays per identifier range, one of occurrences
   and one of record presence.
4. The arrays are summed elementwise by identifier range and joined with the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.runtime import parallelism, stored

#: Identifiers per range; an array of counts has this length.
RANGE = 1 << 14
#: The table of ranges is held by the driver and sent to the tasks; this bounds it (2 MB). With
#: more terms the ranges get wider.
MAX_RANGES = 1 << 18
#: Rows that make one piece at most, on average over the salts of its range.
PIECE_ROWS = 1_000_000
#: Terms with more than one in so many of all rows are hot: there are fewer than this, they are
#: broadcast, and their rows are not shuffled to be encoded. No other term can make a task long.
HOT = 8192
BUFFER_ROWS = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_dictionary(terms: DataFrame) -> DataFrame:
    """(term, id, n_rows) of a one-column frame ``term``: dense ids from 0, in no set order.

    Null terms have no id. The table is written to the shared folder, so ids stay what they are.
    """
    counted = stored(terms.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("n_rows")), "terms")
    n = counted.count()
    n_buckets = max(1, min(MAX_RANGES, -(-n // RANGE)))
    bucketed = counted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(n_buckets)))
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("base"))  # at most MAX_RANGES rows
    ranked = bucketed.withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy("term")))
    return stored(ranked.join(F.broadcast(base), "bucket").select("term", (F.col("base") + F.col("rank") - 1).cast("long").alias("id"), "n_rows"), "dictionary")


def encode(rows: DataFrame, column: str, dictionary: DataFrame, to: str) -> DataFrame:
    """``rows`` with ``column`` replaced by its id in the column ``to``; rows without one are dropped.

    Rows of hot terms get it from a broadcast of these, all others by a shuffle on the term.
    """
    n_rows = dictionary.agg(F.sum("n_rows")).first()[0] or 0
    hot = dictionary.where(F.col("n_rows") * HOT > n_rows).select(F.col("term").alias("hot_term"), F.col("id").alias(to))
    cold = dictionary.where(F.col("n_rows") * HOT <= n_rows).select(F.col("term").alias("dict_term"), F.col("id").alias(to))
    met = rows.join(F.broadcast(hot), rows[column] == F.col("hot_term"), "left")  # fewer than HOT rows
    rest = met.where(F.col(to).isNull()).drop("hot_term", to)
    return met.where(F.col(to).isNotNull()).drop(column, "hot_term").unionByName(rest.join(cold, rest[column] == F.col("dict_term")).drop(column, "dict_term"))


def _split(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    edges = [*starts.tolist(), n]
    return zip(edges[:-1], edges[1:])


def _distinct(i: np.ndarray, r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((p, r, i))
    i, r, p = i[order], r[order], p[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    return i[new], r[new], p[new]


def _pack(width: int, salts: np.ndarray):
    """Packs rows (id, record, position) into one blob per (range, salt) and block of rows."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        i, r, p = (t.column(c).to_numpy() for c in ("id", "record", "position"))
        i, r, p = _distinct(i, r, p)
        block = i // width
        salt = (_mix(r) % salts[block].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((salt, block))
        i, r, p, block, salt = i[order], r[order], p[order], block[order], salt[order]
        start = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (salt[1:] != salt[:-1])])
        low = (i - block * width).astype("<u4")
        blobs = [low[a:b].tobytes() + r[a:b].tobytes() + p[a:b].tobytes() for a, b in _split(start, len(i))]
        return pa.RecordBatch.from_arrays([pa.array(block[start]), pa.array(salt[start].astype(np.int32)), pa.array(blobs, pa.binary())], names=["block", "salt", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= BUFFER_ROWS:
                yield emit(held)
                held, n = [], 0
        if held:
            yield emit(held)

    return run


_ARRAYS = T.StructType([T.StructField("block", T.LongType()), T.StructField("occurrences", T.ArrayType(T.LongType())), T.StructField("records", T.ArrayType(T.LongType()))])


def _arrays(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for block, (occ, rec) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([occ], kind), pa.array([rec], kind)], names=["block", "occurrences", "records"])


def _count(width: int):
    """Counts the pieces of a partition, which come sorted by (range, salt), into arrays."""

    def piece(blobs: list[bytes]) -> np.ndarray:
        i, r, p = [], [], []
        for b in blobs:
            n = len(b) // 16
            i.append(np.frombuffer(b, "<u4", n))
            r.append(np.frombuffer(b, "<i8", n, 4 * n))
            p.append(np.frombuffer(b, "<i4", n, 12 * n))
        i, r, _ = _distinct(np.concatenate(i), np.concatenate(r), np.concatenate(p))
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (r[1:] != r[:-1])
        return np.stack([np.bincount(i, minlength=width), np.bincount(i[new], minlength=width)]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sums = None, [], None
        for batch in batches:
            for block, salt, data in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "data"))):
                if at != (block, salt):
                    if held:
                        sums = piece(held) + (0 if sums is None else sums)
                        held = []
                    if at is not None and at[0] != block:
                        yield from _arrays({at[0]: sums})
                        sums = None
                    at = (block, salt)
                held.append(data)
        if held:
            sums = piece(held) + (0 if sums is None else sums)
        if at is not None:
            yield from _arrays({at[0]: sums})

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the arrays of each range; they come sorted by range."""
    at, sums = None, None
    for batch in batches:
        occ, rec = batch.column("occurrences"), batch.column("records")
        for k, block in enumerate(batch.column("block").to_pylist()):
            one = np.stack([occ[k].values.to_numpy(), rec[k].values.to_numpy()])
            if at == block:
                sums = sums + one
            else:
                if at is not None:
                    yield from _arrays({at: sums})
                at, sums = block, one
    if at is not None:
        yield from _arrays({at: sums})


def term_frequencies(df: DataFrame, term: str, record: str, position: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(term, id, occurrences, records, n_records) of every distinct term of ``df``.

    ``occurrences`` counts the distinct (record, position) of the term, ``records`` its distinct
    records, ``n_records`` the distinct records of the whole table, with or without a term.

    Cases: rows with a null term or null record do not count; a null position is a position of
    its own, so rows that differ in nothing count once; without ``position`` each record counts
    once; ``position`` is an integer of 32 bits, -2147483648 being reserved for null; terms and
    records may be of any type that can be compared; an empty table gives an empty result; other
    columns are not read.
    """
    spark = df.sparkSession
    everything = df.select(
        F.col(term).alias("term"),
        F.col(record).alias("record"),
        F.coalesce(F.col(position).cast("int"), F.lit(-(2**31))).alias("position") if position else F.lit(0).alias("position"),
    ).where(F.col("record").isNotNull())
    rows = everything.where(F.col("term").isNotNull())
    words = build_dictionary(rows.select("term"))
    n_terms = words.count()
    if dict(rows.dtypes)["record"] in ("bigint", "int", "smallint", "tinyint"):
        n_records = everything.select("record").distinct().count()
        rows = rows.withColumn("record", F.col("record").cast("long"))
    else:
        named = build_dictionary(everything.select(F.col("record").alias("term")))
        n_records = named.count()
        rows = encode(rows, "record", named, "record_id").withColumnRenamed("record_id", "record")
    rows = encode(rows, "term", words, "id")
    width = max(RANGE, -(-n_terms // MAX_RANGES))
    per_block = words.groupBy(F.floor(F.col("id") / width).alias("block")).agg(F.sum("n_rows").alias("n")).collect()  # MAX_RANGES rows at most
    salts = np.ones(max([0, *(b["block"] for b in per_block)]) + 1, np.int64)
    for b in per_block:
        salts[b["block"]] = max(1, -(-b["n"] // piece_rows))
    pieces = rows.select("id", "record", "position").mapInArrow(_pack(width, salts), "block long, salt int, data binary")
    n = max(parallelism(spark), int(salts.sum()))
    counted = pieces.repartition(n, "block", "salt").sortWithinPartitions("block", "salt").mapInArrow(_count(width), _ARRAYS)
    sums = counted.repartition("block").sortWithinPartitions("block").mapInArrow(_sum, _ARRAYS)
    flat = sums.select("block", F.posexplode(F.arrays_zip("occurrences", "records")).alias("low", "n")).select((F.col("block") * width + F.col("low")).alias("id"), "n.occurrences", "n.records")
    return words.select("term", "id").join(flat.where(F.col("records") > 0), "id").withColumn("n_records", F.lit(n_records).cast("long")).select("term", "id", "occurrences", "records", "n_records")


def mark(freq: DataFrame, rare_records: int = 1, common_share: float = 0.25) -> Column:
    """``rare``: in at most so many records; ``common``: in more than that share of all; else null.

    A term that is both is rare.
    """
    return F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * F.col("n_records"), "common")
