"""Processing only new or changed records: the target itself is the state.

Every output row carries the key and the version of the source record it was made from. A run
anti-joins the source against the rows already in the target, processes what is left and
publishes the result as the next version of the target. A version becomes visible in one step,
by the rename of its ``_COMMITTED`` marker; whatever a failed run left behind has no marker and
is never read, so a run after a failure neither skips nor repeats a record.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, VERSION = "source_key", "source_version"
_MARK = "_COMMITTED"


def first_seen(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key with the smallest ``at``: a record sent again is the same record.

    Null ``at`` values are ignored unless the key has no other; null keys are no records and left
    out. The aggregate combines before the shuffle, so a key sent a million times costs one row
    per input partition.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias(at))


def unprocessed(source: DataFrame, target: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of ``source`` whose (key, version) no row of ``target`` carries.

    Versions are compared null-safely. ``target`` may hold repeated rows. A changed record is one
    whose version differs from those in the target.
    """
    done = target.select(F.col(KEY).alias("done_key"), F.col(VERSION).alias("done_version"))
    return source.join(done, (source[key] == done["done_key"]) & source[version].eqNullSafe(done["done_version"]), "left_anti")


class Versions:
    """Numbered versions of something below a folder, each committed in one step.

    A version is a folder and a marker that names it. The marker is written aside and renamed into
    place last. It is named by the number alone, so of two runs that race for a number one finds
    it taken and raises ``FileExistsError`` (a rename never replaces a file on HDFS-like stores; on
    a local disk, as in tests, the check before it stands in for that).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.root = self.hadoop.Path(self.path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def list(self) -> list[tuple[int, str]]:
        """(number, folder) of each committed version, in order."""
        if not self.fs.exists(self.root):
            return []
        out = []
        for s in self.fs.listStatus(self.root):
            name = s.getPath().getName()
            if name.endswith(f".{_MARK}"):
                stream = self.fs.open(s.getPath())
                try:
                    out.append((int(name.split(".")[0]), bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return sorted(out)

    def commit(self, folder: str) -> int:
        """Make a folder that is completely written the next version."""
        found = self.list()
        number = found[-1][0] + 1 if found else 1
        part = self.hadoop.Path(self.root, f".{folder}.tmp")
        stream = self.fs.create(part, True)
        stream.write(bytearray(folder.encode()))
        stream.close()
        mark = self.hadoop.Path(self.root, f"{number:09d}.{_MARK}")
        if self.fs.exists(mark) or not self.fs.rename(part, mark):
            raise FileExistsError(f"version {number} was published by another run")
        return number


class Target:
    """A versioned table: each version holds the rows that its run added; the table is their union."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Versions(spark, path)
        self.path = self.store.path

    def versions(self) -> list[tuple[int, str]]:
        return self.store.list()

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(*(f"{self.path}/{folder}" for _, folder in found)) if found else None

    def has(self, label: str) -> bool:
        """Whether a version was published under a label; no rows are read."""
        return any(folder.split("-")[1:-1] == [label] for _, folder in self.versions())

    def publish(self, rows: DataFrame, expected: int | None = None, label: str | None = None) -> int:
        """Commit ``rows`` as the next version; ``expected`` is the latest version the run has read.

        A label has no hyphen and is part of the version's name.
        """
        found = self.versions()
        latest = found[-1][0] if found else 0
        if expected is not None and expected != latest:
            raise FileExistsError(f"version {latest} was published since version {expected} was read")
        folder = "-".join([f"v{latest + 1:09d}", *([label] if label else []), uuid.uuid4().hex])
        rows.write.parquet(f"{self.path}/{folder}")
        if expected is not None and (now := self.versions()) and now[-1][0] != expected:
            raise FileExistsError(f"version {now[-1][0]} was published while version {expected + 1} was written")
        return self.store.commit(folder)

    def vacuum(self) -> int:
        """Delete the data of runs that never committed; returns how many."""
        keep = {folder for _, folder in self.versions()}
        gone = 0
        for s in self.store.fs.listStatus(self.store.root) if self.store.fs.exists(self.store.root) else []:
            name = s.getPath().getName()
            if (name.startswith("v") and name not in keep) or name.endswith(".tmp"):
                gone += bool(self.store.fs.delete(s.getPath(), True))
        return gone


def run_incremental(source: DataFrame, target: Target, key: str, version: str, process: Callable[[DataFrame], DataFrame]) -> tuple[int, DataFrame]:
    """One run: what the target lacks is processed and published; returns its version and rows.

    ``process`` gets the new rows with ``source_key`` and ``source_version`` added and must keep
    both columns. Several changes of a key within one run are all processed.
    """
    found = target.versions()
    latest = found[-1][0] if found else 0
    have = target.read()
    fresh = source if have is None else unprocessed(source, have, key, version)
    fresh = fresh.withColumn(KEY, F.col(key)).withColumn(VERSION, F.col(version))
    number = target.publish(process(fresh), latest)
    return number, target.spark.read.parquet(f"{target.path}/{dict(target.versions())[number]}")


def last_success(runs: DataFrame, group: str, started: str, ok: Column) -> DataFrame:
    """(group, started) of the last successful run of each group; groups without one are absent."""
    return runs.where(ok & F.col(group).isNotNull() & F.col(started).isNotNull()).groupBy(group).agg(F.max(started).alias(started))


def replay(spark: SparkSession, changes: DataFrame, runs: DataFrame, path: str, key: str, group: str, at: str, started: str, ok: Column) -> Target:
    """Rebuild the target that the successful runs so far have left, from a log of runs that is taken over.

    A change was processed by the first successful run of its group that started no earlier than
    it was first recorded; each row says by which (``run_started``), and a change that no run was
    late enough for has no row. Failed runs have left nothing. From then on the target alone is
    the state.
    """
    target = Target(spark, path)
    good = runs.where(ok & F.col(group).isNotNull() & F.col(started).isNotNull())
    starts = good.groupBy(F.col(group).alias("run_group")).agg(F.array_sort(F.collect_set(started)).alias("starts"))
    placed = changes.join(starts, changes[group] == starts["run_group"])
    first = F.get(F.filter("starts", lambda s: s >= F.col(at)), F.lit(0))
    done = placed.select(F.col(key).alias(KEY), F.col(at).alias(VERSION), first.alias("run_started")).where("run_started is not null")
    target.publish(done)
    return target
