"""Mixing sources to target weights by Poisson replication.

Every document draws its number of copies from a Poisson distribution, cut off at the source's
repetition cap, whose mean is the source's target repetition rate. The draw inverts the
distribution at a uniform number hashed from the document's key and a seed, so it needs no
shuffle, is the same on every run, and is independent of the partitioning. Documents are then
exploded by their counts and shuffled globally by a hashed order.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.chars import Hasher, class_table, code_points, groups
from quernel.runtime import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that goes with the vocabulary (fixed value of the public tokenizer). ``Counter``
#: splits texts as it does.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Slots for pre-tokens whose token counts a worker remembers.
SLOTS = 1 << 21
#: Texts are split together up to this many characters.
BATCH_CHARS = 1 << 20

_SPACE, _QUOTE = ord(" "), ord("'")
_SHORT = [ord(c) for c in "stmd"]
_LONG = [tuple(map(ord, s)) for s in ("re", "ve", "ll")]


def split(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each pre-token of texts laid end to end, as ``PATTERN`` finds them.

    A pre-token starts where the class of character changes; the last white space before a
    non-space is a pre-token of its own or, if it is a plain space, the start of the next one;
    an apostrophe that stands alone takes a contraction's letters from the word after it.
    """
    kind = class_table()[points]
    n = len(kind)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= kind == 4
    blank = kind == 3
    before = np.zeros(n, bool)  # white space before a non-space of the same text
    before[:-1] = blank[:-1] & (kind[1:] < 3)
    new |= before
    plain = before & (points == _SPACE)
    new[1:] &= ~plain[:-1]
    alone = np.flatnonzero((points[:-1] == _QUOTE) & new[:-1] & (kind[1:] == 1) & (kind[:-1] == 0))
    alone = alone[new[alone + 1]]
    for q in alone.tolist():
        rest = points[q + 1 : q + 3].tolist()
        k = 1 if rest[0] in _SHORT else 2 if tuple(rest) in _LONG else 0
        if k:
            new[q + 1] = False
            if kind[q + 1 + k] == 1:
                new[q + 1 + k] = True
    start = np.flatnonzero(new)
    end = np.r_[start[1:], n]
    keep = kind[start] != 4
    return start[keep], end[keep]


class Counter:
    """Counts the tokens of many texts at once. Pre-tokens repeat, so their counts are remembered
    by 64-bit hash, in a table that a newcomer's slot overwrites."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.keys, self.counts = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for first, some in groups(texts, BATCH_CHARS):
            points, begin = code_points(some)
            start, end = split(points)
            if not len(start):
                continue
            h = Hasher(points)(start, end) | np.uint64(1)
            slot = h >> np.uint64(64 - SLOTS.bit_length() + 1)
            count = self.counts[slot]
            for i in np.flatnonzero(self.keys[slot] != h).tolist():
                if self.keys[slot[i]] != h[i]:
                    token = points[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass")
                    self.keys[slot[i]], self.counts[slot[i]] = h[i], len(self.encode(token))
                count[i] = self.counts[slot[i]]
            total = np.r_[0, np.cumsum(count)]
            edge = np.searchsorted(start, np.r_[begin, len(points)])
            out[first : first + len(some)] = np.diff(total[edge])
        return out


_counters: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    """The counter of this worker."""
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


def count_tokens(df: DataFrame, key: str, source: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens) of every document; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = counter(vocabulary)(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("source"), pa.array(n, pa.int64())], names=["key", "source", "n_tokens"])

    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    kind = {f.name: f.dataType for f in rows.schema}
    return rows.mapInArrow(run, T.StructType([T.StructField("key", kind["key"]), T.StructField("source", kind["source"]), T.StructField("n_tokens", T.LongType())]))


def truncated_mean(rate: float, cap: int) -> float:
    """Mean of min(Poisson(rate), cap)."""
    if rate <= 0:
        return 0.0
    p, mean, below = math.exp(-rate), 0.0, 0.0
    for k in range(cap):
        if k > rate and p < 1e-17:
            return mean  # no more is left for greater counts
        mean += k * p
        below += p
        p *= rate / (k + 1)
    return mean + cap * max(0.0, 1 - below)


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose mean, cut off at ``cap``, is ``mean``; infinite if it reaches the cap."""
    if mean <= 0:
        return 0.0
    if mean >= cap * (1 - 1e-9):
        return math.inf
    low, high = 0.0, max(1.0, mean)
    while truncated_mean(high, cap) < mean:
        high *= 2
        if high > 700:
            return math.inf
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if truncated_mean(mid, cap) < mean else (low, mid)
    return (low + high) / 2


def thresholds(mean: float, cap: int) -> tuple[int, list[float]]:
    """(copies of every document, P(further copies <= k) for k up to the cap).

    A uniform number's rank among the probabilities is its number of further copies; those that no
    number below 1 exceeds are left out, so that the list is short whatever the cap.
    """
    rate = rate_for(mean, cap)
    if math.isinf(rate):
        return cap, []
    p, total, out = math.exp(-rate), 0.0, []
    for k in range(cap):
        total += p
        if total >= 1 or k > rate and p < 1e-17:
            break
        out.append(total)
        p *= rate / (k + 1)
    return 0, out


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) hashed from the key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def plan_rates(sizes: list[tuple], targets: list[tuple], total: float | None = None) -> tuple[float, dict]:
    """The mixture's size and each source's (share, cap, mean repetitions).

    ``sizes`` holds (source, tokens), ``targets`` (source, share, cap). Unless given, the size is
    the largest at which no source would need more repetitions than its cap. Sources without
    tokens get nothing, and the shares of the others are scaled up to sum to 1.
    """
    have = {s: n for s, n in sizes if n}
    use = [(s, w, c) for s, w, c in targets if s is not None and w and w > 0 and c and c > 0 and have.get(s)]
    weight = sum(w for _, w, _ in use)
    if not use:
        return 0.0, {}
    limit = min(c * have[s] / (w / weight) for s, w, c in use)
    size = limit if total is None else min(float(total), limit)
    return size, {s: (w / weight, c, size * w / weight / have[s]) for s, w, c in use}


class Mixture:
    """``documents``: (key, source, n_tokens, copies); ``report``: shares wanted and reached."""

    def __init__(self, documents: DataFrame, report: DataFrame, size: float):
        self.documents, self.report, self.size = documents, report, size

    def draws(self, seed: int = 0) -> DataFrame:
        """(key, source, n_tokens, copy, position): one row per use, in a global random order.

        Rows are range-partitioned and sorted by ``position``, so writing them gives shuffled files.
        """
        copies = self.documents.where("copies > 0").select("key", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        return copies.withColumn("position", F.xxhash64(F.col("key"), F.col("copy"), F.lit(seed + 1))).repartitionByRange("position").sortWithinPartitions("position")


def mix(df: DataFrame, key: str, source: str, text: str, targets: DataFrame, target_source: str, share: str, cap: str, total: float | None = None, seed: int = 17, vocabulary: str = VOCABULARY, max_sources: int = 10_000) -> Mixture:
    """Draws a mixture in which each source has its target share of all tokens.

    The targets are a table of at most ``max_sources`` rows, held by the driver; the documents'
    tokens are counted once, stored in the shared folder, and summed per source by a partial
    aggregate. The expected share of each source is exact; the reached shares differ by the
    draw's chance, which falls with the number of documents.

    Cases: documents with a null source or one without a target are never drawn; null texts have
    0 tokens; a source that is repeated among the targets counts with its first row in order;
    a repeated document is drawn alike each time; empty tables give an empty mixture; other
    columns are not read.
    """
    want = targets.select(F.col(target_source).alias("source"), F.col(share).cast("double").alias("share"), F.col(cap).cast("int").alias("cap")).orderBy("source", "share", "cap").limit(max_sources + 1).collect()
    if len(want) > max_sources:
        raise ValueError(f"more than {max_sources} targets")
    first: dict = {}
    for r in want:
        first.setdefault(r["source"], r)
    spark = df.sparkSession
    counted = stored(count_tokens(df, key, source, text, vocabulary), "tokens")
    named = F.broadcast(spark.createDataFrame([(s,) for s in first if s is not None], "source string"))  # max_sources rows at most
    counted_wanted = counted.join(named, "source", "left_semi")
    sizes = [(r["source"], r["n"]) for r in counted_wanted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()]
    size, rates = plan_rates(sizes, [(s, r["share"], r["cap"]) for s, r in first.items()], total)
    draw = spark.createDataFrame([(s, *thresholds(mean, c)) for s, (_, c, mean) in rates.items()], "draw_source string, always int, above array<double>")
    u = uniform(F.col("key"), seed)
    copies = F.coalesce(F.col("always") + F.size(F.filter("above", lambda t: u >= t)), F.lit(0))
    documents = counted.join(F.broadcast(draw), F.col("source") == F.col("draw_source"), "left").withColumn("copies", copies.cast("int")).drop("draw_source", "always", "above")
    plan = spark.createDataFrame([(s, float(r["share"] or 0), r["cap"], float(rates[s][2]) if s in rates else 0.0) for s, r in first.items()], "source string, target_share double, max_repeats int, mean_repeats double")
    used = documents.join(named, "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("copies") > 0).cast("long")).alias("n_used"), F.sum("copies").alias("n_draws"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    everything = used.agg(F.sum("tokens").alias("all_tokens"))
    report = (
        plan.join(used, "source", "left")
        .join(F.broadcast(everything))  # one row
        .select("source", "target_share", "max_repeats", "mean_repeats", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_docs", "n_used", "n_draws", "most_repeats", "tokens")), F.coalesce(F.col("tokens") / F.nullif(F.col("all_tokens"), F.lit(0)), F.lit(0.0)).alias("reached_share"))
    )
    return Mixture(documents, report, size)
