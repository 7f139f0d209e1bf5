"""Trigrams and their masks as native expressions over binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.runtime import spread


def trigrams(data: Column) -> Column:
    """Every 3-byte window in order, repeats kept; shorter input has none."""
    return F.when(F.length(data) >= 3, F.transform(F.sequence(F.lit(1), F.length(data) - 2), lambda i: F.substring(data, i, F.lit(3)))).otherwise(F.array().cast("array<binary>"))


def trigram_entries(df: DataFrame, key: str, data: str) -> DataFrame:
    """(trigram, key, n): each trigram of each row and how often it stands there, vectorised.

    Trigrams are whole numbers, the first byte being the highest. The key is an integer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, owners = [], []
            for k, text in enumerate(b.column("data").to_pylist()):
                a = np.frombuffer(text or b"", np.uint8).astype(np.int64)
                if len(a) >= 3:
                    codes.append(a[:-2] << 16 | a[1:-1] << 8 | a[2:])
                    owners.append(np.full(len(a) - 2, k))
            if codes:
                pairs, n = np.unique(np.concatenate(owners) << 24 | np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs & 0xFFFFFF), b.column("key").take(pa.array(pairs >> 24)), pa.array(n.astype(np.int64))], names=["trigram", "key", "n"])

    rows = spread(df.select(F.col(key).cast("long").alias("key"), F.col(data).alias("data")))
    return rows.mapInArrow(run, "trigram long, key long, n long").withColumnRenamed("key", key)


def trigram_hash(trigram: Column) -> Column:
    """CRC-32 of a trigram's bytes."""
    return F.crc32(trigram)


def byte_hash(data: Column, at: Column) -> Column:
    """Low eight bits of the CRC-32 of the byte at the 1-based position."""
    return F.crc32(F.substring(data, at, F.lit(1))).bitwiseAND(F.lit(255))


def trigram_masks(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, trigram, loc_mask, next_mask): where each trigram stands modulo 8, and what follows it.

    Bit ``p % 8`` of ``loc_mask`` is set for each 0-based position ``p``; bit ``h % 8`` of ``next_mask``
    for the hash ``h`` of each byte that follows. Null and short data give no rows. The masks are
    combined before the shuffle.
    """
    rows = df.select(key, F.col(data).alias("data"), F.posexplode(trigrams(F.col(data))).alias("p", "trigram"))
    follows = F.when(F.col("p") + 4 <= F.length("data"), F.expr("shiftleft(1, cast(crc32(substring(data, p + 4, 1)) % 8 as int))")).otherwise(0)
    return rows.groupBy(key, "trigram").agg(F.bit_or(F.expr("shiftleft(1, p % 8)")).alias("loc_mask"), F.bit_or(follows).alias("next_mask"))


def may_follow(first_loc: Column, second_loc: Column) -> Column:
    """Whether a trigram with the second mask can stand one byte after one with the first."""
    turned = F.shiftleft(first_loc, 1).bitwiseOR(F.shiftrightunsigned(first_loc, 7)).bitwiseAND(F.lit(255))
    return turned.bitwiseAND(second_loc) != 0


def may_precede(next_mask: Column, byte_hash_mod: Column) -> Column:
    """Whether the byte with the given hash can follow a trigram with the mask."""
    return F.getbit(next_mask, byte_hash_mod % 8) == 1
