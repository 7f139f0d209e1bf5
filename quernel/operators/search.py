"""Search: the index gives candidate documents, Spark's own expressions verify their lines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.ngrams import sorted_distinct
from quernel.operators.index import Index
from quernel.plans.java import to_java
from quernel.plans.query import NONE, Op, Query, bound, condition, plan, prune, solve
from quernel.runtime import spread
from quernel.sources.corpus import LINE_END, lines, path_order, to_text

#: With more than this share of documents as candidates a plain scan is faster than asking the index.
SCAN_SHARE = 0.3
#: Hashes of one conjunction that are looked up at most; the rarest are taken.
KEEP = 8
#: Postings of a pattern up to which the driver evaluates it (8 MB of ids).
LOCAL_POSTINGS = 1_000_000
#: Candidates that become a list in the filter of the scan; more are broadcast.
LISTED_IDS = 5_000
#: Ranges of ids that the filter of the scan is given besides.
RANGES = 32
#: Candidates that the tasks found are broadcast up to so many (64 MB as a table of hashes).
BROADCAST_IDS = 2_000_000


def id_ranges(ids: np.ndarray, most: int = RANGES) -> str:
    """A condition on doc_id that holds for sorted ids: ranges parted at the widest gaps.

    It reaches the scan, which passes over row groups and pages that lie between them.
    """
    gaps = np.diff(ids)
    cut = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
    cut = cut[gaps[cut] > 1]
    low, high = ids[np.r_[0, cut + 1]], ids[np.r_[cut, len(ids) - 1]]
    return " or ".join(f"doc_id between {a}L and {b}L" for a, b in zip(low.tolist(), high.tolist()))


class Searcher:
    """Searches a corpus (doc_id, root, path, content), with its index or, without one, by scanning.

    Instead of a corpus there may be ``fetch``, which is given documents of the index (doc_id, root,
    path) and gives them back with their contents, such as ``contents`` of the files: then only
    candidates are opened.

    All results are frames. The driver holds the document frequencies of a pattern's few n-grams
    and, of patterns with at most ``LOCAL_POSTINGS`` postings, these. Invalid UTF-8 is replaced.
    A match lies within one line.
    """

    def __init__(self, corpus: DataFrame | None, index: Index | None = None, n_docs: int | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None):
        self.corpus, self.index, self.fetch = corpus, index, fetch if corpus is None else None
        self._n_docs = n_docs

    @property
    def docs(self) -> DataFrame:
        """The documents (doc_id, root, path, …) that are searched."""
        return self.index.docs if self.corpus is None else self.corpus

    def n_docs(self) -> int:
        if self._n_docs is None:
            self._n_docs = self.index.docs.count() if self.index is not None else self.corpus.count()
        return self._n_docs

    def _planned(self, pattern: str, ignore_case: bool, may_scan: bool = True) -> tuple[Query, dict[int, int], dict[int, np.ndarray] | None]:
        """The query, the document frequencies of its hashes and, where documents are few, their lists."""
        q = plan(pattern, ignore_case, self.index.config.max_ngram_length)
        if not q.leaves():
            return q, {}, None
        lists = None
        if len(q.leaves()) * self.n_docs() <= LOCAL_POSTINGS and self.index.stale is None:
            lists = self._read(q)  # no list can be long
            df = {h: len(ids) for h, ids in lists.items()}
        else:
            df = self.index.frequencies(q.leaves())
        q = prune(q, df, KEEP)
        most = bound(q, df, self.n_docs())
        return NONE if most == 0 else Query(Op.ALL) if may_scan and most > SCAN_SHARE * self.n_docs() else q, df, lists

    def plan(self, pattern: str, ignore_case: bool = False) -> Query:
        """The query that will be asked of the index, with only the rarest hashes of conjunctions."""
        return self._planned(pattern, ignore_case)[0]

    def evaluate(self, q: Query) -> DataFrame:
        """(doc_id) of the documents that satisfy a query: one filtered scan and one aggregate."""
        if not q.leaves():
            docs = self.index.docs.select("doc_id")
            return docs if q.op is Op.ALL or (q.op is Op.AND and not q.children) else docs.where("false")
        wanted = sorted(q.leaves())
        rows = self.index.postings.where(F.col("ngram_hash").isin(wanted)).select(F.explode("doc_ids").alias("doc_id"), "ngram_hash")
        held = rows.groupBy("doc_id").agg(*(F.max(F.col("ngram_hash") == h).alias(f"h{h}") for h in wanted))
        return self.index.live(held.where(condition(q, {h: F.col(f"h{h}") for h in wanted})).select("doc_id"))

    def candidates(self, pattern: str, ignore_case: bool = False, use_index: bool | None = None) -> DataFrame:
        """(doc_id) of every document that may have a matching line."""
        return self.evaluate(self._planned(pattern, ignore_case, not use_index)[0])

    def _read(self, q: Query) -> dict[int, np.ndarray]:
        """The sorted lists of a query's hashes, which together have at most ``LOCAL_POSTINGS`` postings."""
        lists: dict[int, list[np.ndarray]] = {}
        found = self.index.postings.where(F.col("ngram_hash").isin(sorted(q.leaves()))).select("ngram_hash", "doc_ids").toArrow()
        for h, ids in zip(found.column("ngram_hash").to_pylist(), (x for c in found.column("doc_ids").chunks for x in c)):
            lists.setdefault(h, []).append(ids.values.to_numpy(zero_copy_only=False))
        return {h: sorted_distinct(np.concatenate(x)) for h, x in lists.items()}

    def _chosen(self, docs: DataFrame, q: Query, df: dict[int, int], lists: dict[int, np.ndarray] | None) -> DataFrame:
        """The rows of ``docs`` that satisfy a query; they are not shuffled unless there are very many."""
        if lists is None and sum(df.get(h, 0) for h in q.leaves()) > LOCAL_POSTINGS:
            found = self.evaluate(q)
            return docs.join(F.broadcast(found) if bound(q, df, self.n_docs()) <= BROADCAST_IDS else found, "doc_id", "left_semi")
        ids = solve(q, self._read(q) if lists is None else lists)
        if not len(ids):
            return docs.where("false")
        near = docs.where(id_ranges(ids))
        if len(ids) <= LISTED_IDS:
            return near.where(f"doc_id in ({', '.join(f'{k}L' for k in ids.tolist())})")
        return near.join(F.broadcast(docs.sparkSession.createDataFrame(pa.table({"doc_id": ids}))), "doc_id", "left_semi")  # LOCAL_POSTINGS ids at most

    def _documents(self, pattern: str, ignore_case: bool, path_filter: str | None, use_index: bool | None) -> DataFrame:
        docs = self.docs
        if path_filter is not None:  # below the verification and, as a filter of one side, below the join
            docs = docs.where(F.col("path").rlike(to_java(path_filter)))
        q, df, lists = (Query(Op.ALL), {}, None) if self.index is None or use_index is False else self._planned(pattern, ignore_case, not use_index)
        if q.leaves():
            docs = self._chosen(docs, q, df, lists)
        elif q.op is Op.NONE or q.op is Op.OR:
            docs = docs.where("false")
        else:
            docs = spread(docs)
        return docs if self.fetch is None else self.fetch(docs)

    def _lines(self, java: str) -> Column:
        """A document's lines; what comes after a final line end is dropped only for patterns that an
        empty line matches, as no other finds anything there, and the plain split is made once."""
        text = to_text(F.col("content"))
        blank = self.docs.sparkSession._jvm.java.util.regex.Pattern.compile(java).matcher("").find()
        return lines(text) if blank else F.split(text, LINE_END, -1)

    def lines(self, pattern: str, ignore_case: bool = False, path_filter: str | None = None, use_index: bool | None = None) -> DataFrame:
        """(doc_id, root, path, line_number, line) of every matching line, line numbers from 1."""
        java = to_java(pattern, ignore_case)
        docs = self._documents(pattern, ignore_case, path_filter, use_index)
        hits = F.filter(F.transform(self._lines(java), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line"))), lambda x: x["line"].rlike(java))
        return docs.select("doc_id", "root", "path", F.explode(hits).alias("hit")).select("doc_id", "root", "path", "hit.line_number", "hit.line")

    def files(self, pattern: str, ignore_case: bool = False, path_filter: str | None = None, use_index: bool | None = None) -> DataFrame:
        """(doc_id, root, path) of every file with a matching line; stops at a file's first."""
        java = to_java(pattern, ignore_case)
        docs = self._documents(pattern, ignore_case, path_filter, use_index)
        return docs.where(F.exists(self._lines(java), lambda x: x.rlike(java))).select("doc_id", "root", "path")

    def counts(self, pattern: str, ignore_case: bool = False, path_filter: str | None = None, use_index: bool | None = None) -> DataFrame:
        """(doc_id, root, path, n) of files with matching lines: no line leaves its row, nothing is shuffled."""
        java = to_java(pattern, ignore_case)
        docs = self._documents(pattern, ignore_case, path_filter, use_index)
        n = F.size(F.filter(self._lines(java), lambda x: x.rlike(java)))
        return docs.select("doc_id", "root", "path", n.cast("long").alias("n")).where("n > 0")

    def exists(self, pattern: str, ignore_case: bool = False, path_filter: str | None = None, use_index: bool | None = None) -> bool:
        return not self.files(pattern, ignore_case, path_filter, use_index).isEmpty()


def ordered(hits: DataFrame) -> DataFrame:
    """Results by root, path (component by component) and line."""
    keys: list[Column] = [F.col("root"), path_order(F.col("path"))]
    return hits.orderBy(*keys, *([F.col("line_number")] if "line_number" in hits.columns else []))


def formatted(hits: DataFrame, line_numbers: bool = False) -> DataFrame:
    """One text column ``result``: path, path:n, path:line or path:number:line."""
    if "line" in hits.columns:
        parts = ["path", F.col("line_number").cast("string"), "line"] if line_numbers else ["path", "line"]
    else:
        parts = ["path", F.col("n").cast("string")] if "n" in hits.columns else ["path"]
    return hits.select(F.concat_ws(":", *parts).alias("result"))
