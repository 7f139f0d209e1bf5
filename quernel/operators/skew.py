"""Per-key folds over data in which a few keys hold most of the rows.

Exact offset chunking: the rows of each key are counted per input partition, the counts are
prefix-summed to offsets, every row thereby has an exact ordinal within its key, and the
ordinals cut each key into equal chunks. Chunks are folded independently; their ordered
boundary states are then merged per key. No task ever holds a whole key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.runtime import stable_scan, stored

#: Rows that a task folds at once.
BUFFER_ROWS = 1 << 20
#: No key is cut into more chunks than this, so that merging the chunks of one key stays small.
MAX_CHUNKS = 4096
MIN_CHUNK_ROWS = 1 << 13
#: Offsets of hot keys are sent to the rows by broadcast up to this many entries (about 16 MB);
#: beyond it they are joined by a shuffle on (partition, key), which is even by construction.
BROADCAST_OFFSETS = 400_000


def _buffers(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(col: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Integer codes of the values (null is a value of its own) and the value of each code."""
    enc = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(enc, pa.ChunkedArray):
        enc = pa.concat_arrays(enc.chunks) if enc.num_chunks else pa.array([], enc.type)
    enc = enc.dictionary_encode(null_encoding="encode")
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def _fold_fragments(chunk_rows: int):
    """Folds rows, in stored order, to one state per (partition, key, chunk) and buffer.

    The rows hold (part, key, value, measure, start): ``start`` is the key's offset at the start
    of the partition, null for keys that fit into one chunk.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for t in _buffers(batches, BUFFER_ROWS):
            part = t.column("part").to_numpy()
            kcode, kdict = _codes(t.column("key"))
            vcode, vdict = _codes(t.column("value"))
            measure = t.column("measure")
            filled = pc.fill_null(measure, 0).to_numpy()
            known = pc.is_valid(measure).to_numpy()
            start = pc.fill_null(t.column("start"), -1).to_numpy()
            order = np.lexsort((kcode, part)) if part[0] != part[-1] else np.argsort(kcode, kind="stable")
            p, k, v, m, ok, s = (x[order] for x in (part, kcode, vcode, filled, known, start))
            new = np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(k)])
            keys = kdict.take(pa.array(k[first])).to_pylist()
            base = np.empty(len(first), np.int64)
            for i, (q, key, n) in enumerate(zip(p[first].tolist(), keys, size.tolist())):
                at = (q, key)
                base[i] = seen.get(at, 0)
                seen[at] = int(base[i]) + n
            local = np.arange(len(k)) - np.repeat(first, size) + np.repeat(base, size)
            chunk = np.where(s < 0, 0, (s + local) // chunk_rows)
            new[1:] |= chunk[1:] != chunk[:-1]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(k)] - 1
            size = last - first + 1
            changes = np.r_[True, v[1:] != v[:-1]] | new
            has_value = np.array([x is not None for x in vdict.to_pylist()], bool)[v] if len(vdict) else np.zeros(len(v), bool)
            low = np.minimum.reduceat(np.where(ok, m, np.iinfo(np.int64).max), first)
            high = np.maximum.reduceat(np.where(ok, m, np.iinfo(np.int64).min), first)
            any_m = np.add.reduceat(ok.astype(np.int64), first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p[first], pa.int32()),
                    kdict.take(pa.array(k[first])),
                    pa.array(chunk[first], pa.int64()),
                    pa.array(local[first], pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(np.add.reduceat(has_value.astype(np.int64), first)),
                    pa.array(np.add.reduceat(changes.astype(np.int64), first)),
                    vdict.take(pa.array(v[first])),
                    vdict.take(pa.array(v[last])),
                    pa.array(low, mask=any_m == 0),
                    pa.array(high, mask=any_m == 0),
                    pa.array(np.add.reduceat(np.where(ok, m, 0), first), mask=any_m == 0),
                ],
                names=["part", "key", "chunk", "at", "n_rows", "n_values", "n_runs", "first_value", "last_value", "min_measure", "max_measure", "sum_measure"],
            )

    return fold


def _merge(states: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Merges ordered states: a run that crosses a boundary is counted once."""
    w = W.partitionBy(*by).orderBy(*order)
    touching = F.lag(F.lit(True)).over(w).isNotNull() & F.lag("last_value").over(w).eqNullSafe(F.col("first_value"))
    place: Column = F.struct(*order)
    return (
        states.withColumn("joined", touching.cast("long"))
        .groupBy(*by)
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_values").alias("n_values"),
            (F.sum("n_runs") - F.sum("joined")).alias("n_runs"),
            F.min_by("first_value", place).alias("first_value"),
            F.max_by("last_value", place).alias("last_value"),
            F.min("min_measure").alias("min_measure"),
            F.max("max_measure").alias("max_measure"),
            F.sum("sum_measure").alias("sum_measure"),
            F.count(F.lit(1)).alias("n_states"),
        )
    )


def key_offsets(df: DataFrame, key: str) -> DataFrame:
    """(part, key, n, start, total): rows of each key per input partition and their prefix sums."""
    counts = df.groupBy(F.spark_partition_id().alias("part"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    by_key = W.partitionBy("key")
    before = by_key.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("part", "key", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(by_key).alias("total"))


def fold_by_key(df: DataFrame, key: str, value: str, measure: str | None = None, chunk_rows: int | None = None, broadcast_offsets: int = BROADCAST_OFFSETS) -> DataFrame:
    """Folds all rows of each key, in stored order, without giving any key to one task.

    Returns one row per key: ``key, n_rows, n_values`` (non-null values), ``n_runs`` (maximal
    runs of equal consecutive values, null being equal to null), ``first_value, last_value,
    min_measure, max_measure, sum_measure, n_chunks, total_rows``.

    ``chunk_rows`` is the size of a chunk; by default a 4096th of all rows, 8192 at least, so
    that no key has more than 4096 chunks. The input must have stable partitions; a plan that is
    no plain file scan is first written to the shared folder.

    Cases: a null key is a key; null values take part in runs; null measures are left out of
    min, max and sum, which are null if nothing is left; repeated rows count as often as they are
    stored; an empty table gives an empty result; other columns, whatever their names, are not
    read.
    """
    cols = [F.col(key).alias("key"), F.col(value).alias("value"), (F.col(measure).cast("long") if measure else F.lit(None).cast("long")).alias("measure")]
    rows = stable_scan(df.select(*cols), "fold-input")
    kind = {f.name: f.dataType for f in rows.schema}
    total = rows.count()
    chunk_rows = chunk_rows or max(MIN_CHUNK_ROWS, -(-total // MAX_CHUNKS))
    hot = stored(key_offsets(rows, "key").where(F.col("total") > chunk_rows).select(F.col("part").alias("hot_part"), F.col("key").alias("hot_key"), "start"), "offsets")
    on = (F.col("part") == F.col("hot_part")) & F.col("key").eqNullSafe(F.col("hot_key"))
    placed = rows.withColumn("part", F.spark_partition_id())
    if hot.count() <= broadcast_offsets:
        numbered = placed.join(F.broadcast(hot), on, "left")
    else:
        numbered = placed.withColumn("row_no", F.monotonically_increasing_id()).join(hot.hint("merge"), on, "left").sortWithinPartitions("part", "row_no")
    state = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("key", kind["key"])]
        + [T.StructField(c, T.LongType()) for c in ("chunk", "at", "n_rows", "n_values", "n_runs")]
        + [T.StructField(c, kind["value"]) for c in ("first_value", "last_value")]
        + [T.StructField(c, T.LongType()) for c in ("min_measure", "max_measure", "sum_measure")]
    )
    fragments = numbered.select("part", "key", "value", "measure", "start").mapInArrow(_fold_fragments(chunk_rows), state)
    chunks = _merge(fragments, ["key", "chunk"], ["part", "at"])
    return _merge(chunks, ["key"], ["chunk"]).withColumnRenamed("n_states", "n_chunks").withColumn("total_rows", F.lit(total))


def hot_keys(folded: DataFrame, share: float) -> DataFrame:
    """The non-null keys that hold more than ``share`` of all rows."""
    return folded.where(F.col("key").isNotNull() & (F.col("n_rows") > F.lit(share) * F.col("total_rows"))).select("key", "n_rows")
