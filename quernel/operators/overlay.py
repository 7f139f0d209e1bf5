"""Overlays: a base index or result brought up to date with the files changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.index import Index, append, build, merge, open_index
from quernel.operators.search import Searcher
from quernel.runtime import stored


def detect_changes(before: DataFrame, after: DataFrame, content: str = "content") -> DataFrame:
    """(root, path, status) between two snapshots (root, path, content): new, modified or deleted."""
    mark = lambda df, name: df.select("root", "path", F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256).alias(name))
    both = mark(before, "old").join(mark(after, "fresh"), ["root", "path"], "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("fresh").isNull(), "deleted").when(F.col("old") != F.col("fresh"), "modified")
    return both.select("root", "path", status.alias("status")).where("status is not null")


def drop_stale(results: DataFrame, docs: DataFrame, changes: DataFrame) -> DataFrame:
    """``results`` (doc_id, …) without the documents whose path was modified or deleted.

    An id that no document has is kept.
    """
    gone = changes.where(F.col("status").isin("modified", "deleted")).select("root", "path")
    stale = docs.join(gone, ["root", "path"], "left_semi").select("doc_id")
    return results.join(stale, "doc_id", "left_anti")


def _delta(index: Index, corpus: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids that are gone, documents to be indexed)."""
    gone = changes.where(F.col("status").isin("modified", "deleted")).select("root", "path")
    stale = index.docs.join(gone, ["root", "path"], "left_semi").select("doc_id")
    fresh = corpus.join(changes.where(F.col("status").isin("modified", "new")).select("root", "path"), ["root", "path"], "left_semi")
    return stale, fresh.select("doc_id", "root", "path", "content")


def refresh(index: Index, corpus: DataFrame, changes: DataFrame) -> Index:
    """The index brought up to date: stale documents leave, modified and new ones of ``corpus`` are indexed.

    Only changed documents are tokenised, and the postings of others are left where they are. The
    ids in ``corpus`` of changed files must be new ones.
    """
    stale, fresh = _delta(index, corpus, changes)
    return merge(index, build(fresh, index.config), stored(stale, "stale"))


def refresh_stored(spark: SparkSession, path: str, corpus: DataFrame, changes: DataFrame, commit: str | None = None) -> int:
    """``refresh`` of the latest version below ``path``, stored as its next one by a segment of the changes alone."""
    index = open_index(spark, path)
    stale, fresh = _delta(index, corpus, changes)
    return append(spark, path, build(fresh, index.config), stale, commit, fresh)


def search_with_overlay(base: Searcher, current: DataFrame, changes: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Matching lines of the current state: the base's without stale files, plus those of changed files."""
    old = drop_stale(base.lines(pattern, ignore_case), base.docs.select("doc_id", "root", "path"), changes)
    fresh = current.join(changes.where(F.col("status").isin("modified", "new")).select("root", "path"), ["root", "path"], "left_semi")
    return old.unionByName(Searcher(fresh).lines(pattern, ignore_case))
