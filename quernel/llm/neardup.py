"""Near-duplicate records: SetSketch registers, banding, likelihood estimate, exact verification.

The set of a record's distinct elements is packed into one sorted blob. Records with equal sets
form a class, of which one representative goes on. Its SetSketch has ``M`` registers
``K_i = clamp(floor(1 - log_b x_i), 0, q + 1)`` with ``x_i`` the minimum of exponential variates
seeded by the elements: exponentially spaced, truncated minima. Registers of a union are the
elementwise maxima, and two records agree in a register with a probability close to their
Jaccard similarity. Representatives that agree in all registers of a band are candidates;
their similarity is estimated jointly with both sizes by maximum likelihood from the number of
greater, smaller and equal registers, and what is not clearly below the threshold is verified
on the sets themselves.

The members of a band's bucket meet in one task, sorted. A bucket with many members is cut into
chunks, and each pair of chunks is a task of its own that compares registers before anything is
given on: no task holds more than two chunks, and no pair leaves it that is clearly below the
threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.ngrams import sorted_distinct
from quernel.runtime import parallelism, stored

BASE = 1.001
Q = (1 << 16) - 2
RATE = 20.0
ROWS, BANDS = 6, 74
M = ROWS * BANDS
#: Standard errors that an estimate must lie below the threshold for a candidate to be left out.
SIGMAS = 5.0
BUFFER_ROWS = 1 << 20
#: A record with more rows than this is cut into pieces by element, merged where needed.
GIANT_ROWS = 1 << 22
BROADCAST_GIANTS = 500_000
#: Elements whose registers are computed at once.
STEP = 1 << 15
#: Members of a bucket up to which all its pairs are candidates, and members of a chunk of larger ones.
BUCKET_ROWS = 64
CHUNK_ROWS = 1024
#: A bucket with this share of the keys of a block of rows is cut into chunks before it meets anywhere.
HEAVY_SHARE = 1e-4

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTOR = mix64(np.arange(M, dtype=np.uint64)) | np.uint64(1)


def register_minima(elements: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For sets laid end to end, the largest 64-bit hash per set and register."""
    base = mix64(elements.astype(np.uint64))
    out = np.empty((len(start), M), np.uint64)
    for j in range(M):
        h = base * _FACTOR[j]
        h ^= h >> np.uint64(32)
        h *= _FACTOR[(j * 7 + 3) % M]
        out[:, j] = np.maximum.reduceat(h, start)
    return out


def registers(largest: np.ndarray) -> np.ndarray:
    """SetSketch registers from the largest hashes: the larger the hash, the smaller the minimum."""
    u = (largest.astype(np.float64) + 1.0) * 2.0**-64
    x = -np.log(np.clip(u, 1e-300, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype("<u2")


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihood_jaccard(na: np.ndarray, nb: np.ndarray, greater: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and the set sizes.

    With u, v the sizes' shares, a register of A is greater with probability p(u - vJ) and less
    with p(v - uJ). The log likelihood is concave in J; it is maximised by bisection of its
    derivative over [0, min(u/v, v/u)].
    """
    u, v = na / (na + nb), nb / (na + nb)
    equal = M - greater - less
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    step = 1e-6

    def value(j: np.ndarray) -> np.ndarray:
        g, s = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
        return greater * np.log(g) + less * np.log(s) + equal * np.log(np.maximum(1 - g - s, 1e-12))

    for _ in range(30):
        mid = (low + high) / 2
        up = value(mid + step) > value(mid - step)
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted blob of distinct elements per (record, piece) and block of rows."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        r, e, pieces = t.column("record").to_numpy(), t.column("element").to_numpy(), t.column("pieces").to_numpy()
        piece = np.where(pieces > 1, (mix64(e.astype(np.uint64)) >> np.uint64(40)) % pieces.astype(np.uint64), 0).astype(np.int64)
        order = np.lexsort((e, piece, r))
        r, e, piece, pieces = r[order], e[order], piece[order], pieces[order]
        head = np.r_[True, (r[1:] != r[:-1]) | (piece[1:] != piece[:-1])]
        keep = head.copy()
        keep[1:] |= e[1:] != e[:-1]
        r, e, piece, pieces, head = r[keep], e[keep], piece[keep], pieces[keep], head[keep]
        start = np.flatnonzero(head)
        edges = [*start.tolist(), len(e)]
        blobs = [e[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(r[start]), pa.array(piece[start]), pa.array(pieces[start]), pa.array(blobs, pa.binary())], names=["record", "piece", "pieces", "data"])

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


def _digest(e: np.ndarray) -> tuple[int, int]:
    """128 bits: two sums without carry of element hashes, equal for equal sets and additive over pieces."""
    a, b = mix64(e.astype(np.uint64)), mix64(e.astype(np.uint64) ^ _GOLD)
    return int(np.bitwise_xor.reduce(a).astype(np.int64)), int(np.bitwise_xor.reduce(b).astype(np.int64))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, d1, d2, blobs = [], [], [], []
        for parts in batch.column("parts").to_pylist():
            e = np.frombuffer(parts[0], "<i8") if len(parts) == 1 else sorted_distinct(np.concatenate([np.frombuffer(p, "<i8") for p in parts]))
            a, b = _digest(e)
            sizes.append(len(e))
            d1.append(a)
            d2.append(b)
            blobs.append(e.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("record"), batch.column("piece"), batch.column("pieces"), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(blobs, pa.binary())],
            names=["record", "piece", "pieces", "size", "d1", "d2", "data"],
        )


def record_sets(df: DataFrame, record: str, element: str) -> DataFrame:
    """(record, piece, pieces, size, d1, d2, data): the distinct elements of each record, packed.

    Elements are 64-bit integers. Almost every record is one piece; those with more than
    ``GIANT_ROWS`` rows are cut by element, so that no task holds one of them whole.
    """
    rows = df.select(F.col(record).cast("long").alias("record"), F.col(element).cast("long").alias("element")).where(F.col("record").isNotNull() & F.col("element").isNotNull())
    giants = stored(rows.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GIANT_ROWS).select(F.col("record").alias("giant"), F.ceil(F.col("n") / GIANT_ROWS).alias("pieces")), "giants")
    n_giants = giants.count()
    if n_giants:
        rows = rows.join(F.broadcast(giants) if n_giants <= BROADCAST_GIANTS else giants, F.col("record") == F.col("giant"), "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)).cast("long"))
    else:
        rows = rows.withColumn("pieces", F.lit(1).cast("long"))
    packed = rows.select("record", "element", "pieces").mapInArrow(_pack, "record long, piece long, pieces long, data binary")
    return packed.groupBy("record", "piece").agg(F.first("pieces").alias("pieces"), F.collect_list("data").alias("parts")).mapInArrow(_merge, "record long, piece long, pieces long, size long, d1 long, d2 long, data binary")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column("data").to_pylist()
        size = [len(d) // 8 for d in data]
        at = 0
        while at < len(data):
            to, n = at, 0
            while to < len(data) and (n == 0 or n + size[to] <= STEP):
                n += size[to]
                to += 1
            e = np.frombuffer(b"".join(data[at:to]), "<i8")
            start = np.r_[0, np.cumsum(size[at : to - 1])].astype(np.int64)
            reg = registers(register_minima(e, start))
            yield pa.RecordBatch.from_arrays([batch.column("record").slice(at, to - at), pa.array([x.tobytes() for x in reg], pa.binary())], names=["record", "registers"])
            at = to


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [np.max([np.frombuffer(p, "<u2") for p in parts], axis=0).tobytes() for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(out, pa.binary())], names=["record", "registers"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix64(np.arange(BANDS, dtype=np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        reg = np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(salt, reg.shape[:2])
        for i in range(ROWS):
            key = mix64(key ^ reg[:, :, i])
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("record").to_numpy(), BANDS))], names=["key", "record"])


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the keys that are frequent within a block of rows."""

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        key = np.sort(np.concatenate(held))
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[head, len(key)])
        some = (n > BUCKET_ROWS) & (n > HEAVY_SHARE * len(key))
        return pa.RecordBatch.from_arrays([pa.array(key[head[some]]), pa.array(n[some])], names=["key", "n"])

    held, n = [], 0
    for b in _bands(batches):
        held.append(b.column("key").to_numpy())
        n += len(held[-1])
        if n >= BUFFER_ROWS:
            yield frequent(held)
            held, n = [], 0
    if held:
        yield frequent(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, record), sorted, to (a, b, key, chunk): the pairs of small buckets, and the members of large ones.

    A pair has no key; a member of a large bucket is ``a``, with the bucket's key and its chunk.
    """

    def pairs(key: np.ndarray, record: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.arange(len(key) - 1)
        d = 1
        while len(at := at[at + d < len(key)]) and len(at := at[key[at] == key[at + d]]):
            yield record[at], record[at + d]
            d += 1

    def batch(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None, chunk: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x) if x is not None else none for x in (a, b, key, chunk)], names=["a", "b", "key", "chunk"])

    key, record, large, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), None, 0
    for b in batches:
        key, record = np.r_[key, b.column("key").to_numpy()], np.r_[record, b.column("record").to_numpy()]
        if not len(key):
            continue
        if large is not None:  # the rest of a large bucket
            n = int(np.searchsorted(key != large, True)) if (key != large).any() else len(key)
            if n:
                yield batch(record[:n], None, key[:n], (seen + np.arange(n)) // CHUNK_ROWS)
            seen, key, record = seen + n, key[n:], record[n:]
            if not len(key):
                continue
            large = None
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[head, len(key)])
        big = np.flatnonzero(size > BUCKET_ROWS)
        for k in big.tolist():
            x, y = head[k], head[k] + size[k]
            yield batch(record[x:y], None, key[x:y], np.arange(y - x) // CHUNK_ROWS)
        last = len(head) - 1
        if size[last] > BUCKET_ROWS:
            large, seen, cut = int(key[-1]), int(size[last]), len(key)
        else:
            cut = int(head[last])
        inside = np.repeat(size <= BUCKET_ROWS, size)[:cut]
        for a, c in pairs(key[:cut][inside], record[:cut][inside]):
            yield batch(np.minimum(a, c), np.maximum(a, c), None, None)
        key, record = key[cut:], record[cut:]
    for a, c in pairs(key, record):
        yield batch(np.minimum(a, c), np.maximum(a, c), None, None)


def _registers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, M)


def _likely(x: np.ndarray, y: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, whether it is not clearly below the threshold) of pairs of registers."""
    j = likelihood_jaccard(na, nb, (x > y).sum(1), (x < y).sum(1))
    return j, j >= threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / M)


def _estimate(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                na, nb = (b.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                j, keep = _likely(_registers(b.column("ra")), _registers(b.column("rb")), na, nb, threshold)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(j)], names=["a", "b", "estimate"]).filter(pa.array(keep))

    return run


def _blocks(threshold: float):
    """The likely pairs between two chunks of a bucket, or within one, by their registers."""
    # registers agree at least as often as sets are similar
    agree = (threshold - (SIGMAS + 1) * float(np.sqrt(threshold * (1 - threshold) / M))) * M

    def run(t: pa.Table) -> pa.Table:
        low, high, chunk = t.column("low")[0].as_py(), t.column("high")[0].as_py(), t.column("chunk").to_numpy()
        order = np.argsort(t.column("record").to_numpy(), kind="stable")
        record, size, chunk = t.column("record").to_numpy()[order], t.column("n_elements").to_numpy()[order].astype(float), chunk[order]
        reg = _registers(t.column("registers"))[order]
        right = np.flatnonzero(chunk == high)
        a, b, est = [], [], []
        for i in np.flatnonzero(chunk == low).tolist():
            other = right[right > i] if low == high else right
            other = other[np.minimum(size[other], size[i]) >= threshold * np.maximum(size[other], size[i])]
            other = other[(reg[other] == reg[i]).sum(1) >= agree]
            if len(other):
                j, keep = _likely(np.broadcast_to(reg[i], (len(other), M)), reg[other], np.full(len(other), size[i]), size[other], threshold)
                a.append(np.full(int(keep.sum()), record[i]))
                b.append(record[other[keep]])
                est.append(j[keep])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        # the estimate is symmetric, but for rounding
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "estimate": np.concatenate([np.zeros(0), *est])})

    return run


def likely_pairs(sketches: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs that share a band and whose estimated similarity is not clearly below the threshold.

    ``sketches`` (record, registers), ``sizes`` (record, n_elements).
    """
    keys = sketches.mapInArrow(_bands, "key long, record long")
    heavy = stored(sketches.mapInArrow(_heavy, "key long, n long").groupBy("key").agg(F.sum("n").alias("n_key")), "heavy")  # 1 / HEAVY_SHARE rows a block at most
    n_heavy = heavy.count()
    light = keys if not n_heavy else keys.join(F.broadcast(heavy) if n_heavy <= BROADCAST_GIANTS else heavy, "key", "left_anti")
    n = parallelism(sketches.sparkSession)
    met = stored(light.repartition(n, "key").sortWithinPartitions("key", "record").mapInArrow(_meet, "a long, b long, key long, chunk long"), "met")
    sized = sketches.join(sizes, "record")
    compared = (
        met.where("b is not null").select("a", "b").distinct()
        .join(sized.select(F.col("record").alias("a"), F.col("registers").alias("ra"), F.col("n_elements").alias("na")), "a")
        .join(sized.select(F.col("record").alias("b"), F.col("registers").alias("rb"), F.col("n_elements").alias("nb")), "b")
        .where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
        .mapInArrow(_estimate(threshold), "a long, b long, estimate double")
    )
    large = met.where("b is null").select("key", F.col("a").alias("record"), "chunk")
    if n_heavy:
        cut = F.pmod(F.xxhash64("record"), F.ceil(F.col("n_key") / CHUNK_ROWS))
        large = large.unionByName(keys.join(F.broadcast(heavy) if n_heavy <= BROADCAST_GIANTS else heavy, "key").select("key", "record", cut.alias("chunk")))
    large = stored(large, "large")
    if not large.isEmpty():
        chunks = large.groupBy("key").agg((F.max("chunk") + 1).alias("n_chunks"))
        copies = large.join(chunks, "key").join(sized, "record").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
        blocks = copies.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "record", "n_elements", "registers")
        within = blocks.groupBy("key", "low", "high").applyInArrow(_blocks(threshold), "a long, b long, estimate double")
        compared = compared.unionByName(within)
        return stored(compared, "likely").select("a", "b").distinct()
    return stored(compared.select("a", "b"), "likely")


def components(links: DataFrame) -> DataFrame:
    """(node, group): for each node of the links (a, b), the smallest node that it is connected with.

    Stars are enlarged and shrunk in turn until nothing changes; a round shuffles the links, and
    their number falls. The rounds grow with the logarithm of the longest chain.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        grown = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "grown")
        least = grown.groupBy("u").agg(F.min("v").alias("m"))
        hung = grown.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stored(hung.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("group"))).distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shared = [len(np.intersect1d(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8"), assume_unique=True)) for x, y in zip(b.column("da").to_pylist(), b.column("db").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("na"), b.column("nb"), pa.array(shared, pa.int64())], names=["a", "b", "na", "nb", "shared"])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r, d in zip(b.column("record").to_pylist(), b.column("data").to_pylist()):
            e = np.frombuffer(d, "<i8")
            for at in range(0, len(e), 1 << 16):
                part = e[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), r)), pa.array(part)], names=["record", "element"])


class NearDuplicates:
    """``members``: (record, class_id, size); ``links``: (a, b, jaccard) between class representatives.

    The class id is the smallest record of those with an equal set. ``links`` holds every pair of
    classes found to have a Jaccard similarity of at least ``threshold``; a pair at exactly the
    threshold is missed with a probability below ``(1 - threshold ** 6) ** 74`` (1e-4 at 0.7,
    1e-10 at 0.8). Records with fewer than ``least`` distinct elements are left out.
    """

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """(a, b): all pairs of records, a < b, of linked classes and within a class."""
        m = self.members.select("class_id", "record")
        left, right = m.select(F.col("class_id").alias("ca"), F.col("record").alias("ra")), m.select(F.col("class_id").alias("cb"), F.col("record").alias("rb"))
        shared = self.members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
        both = self.links.select("a", "b").unionByName(shared)
        found = both.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb")).where((F.col("a") != F.col("b")) | (F.col("ra") < F.col("rb")))
        return found.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))

    def groups(self) -> DataFrame:
        """(record, class_id, n_copies, n_links, group_id): one row per record, as its class has them.

        ``group_id`` is the smallest class of those that links connect, over any number of them.
        """
        ends = self.links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
        copies = self.members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_copies"))
        group = components(self.links).select(F.col("node").alias("class_id"), F.col("group").alias("group_id"))
        whole = self.members.join(copies, "class_id").join(ends, "class_id", "left").join(group, "class_id", "left")
        return whole.select("record", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))


def near_duplicates(df: DataFrame, record: str, element: str, threshold: float = 0.8, least: int = 1) -> NearDuplicates:
    """Groups the records of the rows (record, element) by the similarity of their element sets.

    Cases: rows with a null record or element do not count; repeated rows count once; records
    and elements are integers (hash other types first); an empty table gives empty results; other
    columns are not read.
    """
    sets = stored(record_sets(df, record, element), "sets")
    whole = sets.groupBy("record").agg(F.sum("size").alias("size"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.max("pieces").alias("pieces")).where(F.col("size") >= least)
    classes = whole.groupBy("size", "d1", "d2").agg(F.min("record").alias("class_id"), F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces"))
    classes = stored(classes, "classes")
    members = stored(whole.join(classes.select("size", "d1", "d2", "class_id"), ["size", "d1", "d2"]).select("record", "class_id", "size"), "members")
    chosen = classes.select(F.col("class_id").alias("record"), F.col("size").alias("n_elements"))
    bodies = sets.join(chosen, "record", "left_semi")
    parts = bodies.mapInArrow(_sketch, "record long, registers binary")
    n_giants = sets.where("pieces > 1").count()
    if n_giants:
        parts = parts.groupBy("record").agg(F.collect_list("registers").alias("parts")).mapInArrow(_union, "record long, registers binary")
    sketches = stored(parts, "sketches")
    likely = likely_pairs(sketches, chosen, threshold)
    small = sets.where("pieces = 1").select("record", "size", "data")
    checked = (
        likely.select("a", "b")
        .join(small.select(F.col("record").alias("a"), F.col("size").alias("na"), F.col("data").alias("da")), "a")
        .join(small.select(F.col("record").alias("b"), F.col("size").alias("nb"), F.col("data").alias("db")), "b")
        .mapInArrow(_verify, "a long, b long, na long, nb long, shared long")
    )
    if n_giants:
        big = sets.where("pieces > 1").select("record").distinct()
        hard = likely.join(big.select(F.col("record").alias("a")), "a", "left_semi").unionByName(likely.join(big.select(F.col("record").alias("b")), "b", "left_semi").join(big.select(F.col("record").alias("a")), "a", "left_anti").select("a", "b"))
        flat = sets.select("record", "data").mapInArrow(_explode, "record long, element long")
        ea = hard.select("a", "b").join(flat.select(F.col("record").alias("a"), "element"), "a")
        eb = hard.select("a", "b").join(flat.select(F.col("record").alias("b"), "element"), "b")
        counted = ea.join(eb, ["a", "b", "element"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
        counted = counted.join(chosen.select(F.col("record").alias("a"), F.col("n_elements").alias("na")), "a").join(chosen.select(F.col("record").alias("b"), F.col("n_elements").alias("nb")), "b")
        checked = checked.unionByName(counted.select("a", "b", "na", "nb", "shared"))
    union = F.col("na") + F.col("nb") - F.col("shared")
    # the quotient of two integers below 2**53 is rounded correctly, so 7/10 compares equal to 0.7
    links = checked.withColumn("jaccard", F.col("shared") / union).where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")
    return NearDuplicates(members, stored(links, "links"))
