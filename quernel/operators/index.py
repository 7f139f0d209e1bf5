"""The inverted index: n-gram hash to documents, built, stored, opened and refreshed as tables.

A stored index is a list of segments. A refresh adds a segment of the new documents and a table of
the ids that are gone; both cost what has changed, not what there is. ``compact`` makes one segment.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.ngrams import count_ngrams, tokenise, tokenise_packed, unpack_lists
from quernel.operators import postings as P
from quernel.operators.incremental import Versions
from quernel.runtime import estimated_bytes, parallelism, spread, stored
from quernel.sources.corpus import IndexConfig

FORMAT = 2
#: Bytes of text whose n-grams make one bucket of hashes; one task builds a bucket's lists.
BUCKET_BYTES = 8 << 20
#: Buckets are this many bits of a hash at most; a task holds one span of ids of one bucket at a time.
MAX_BITS = 16
_POSTINGS = "ngram_hash long, chunk long, n_docs int, doc_ids array<long>"
#: Sorted hashes and ids are stored as differences.
#: Stored texts are read by ranges of ids: a page has few rows, so that others are passed over.
_PAGES = {"compression": "zstd", "parquet.page.row.count.limit": "256", "parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false"}
_DELTAS = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}


def index_entries(corpus: DataFrame, config: IndexConfig = IndexConfig(), distinct: bool = True) -> DataFrame:
    """(ngram_hash, doc_id), once per document and hash, or with ``distinct=False`` (…, pos) per occurrence."""
    schema = "ngram_hash long, doc_id long" + ("" if distinct else ", pos int")
    return spread(corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "content")).mapInArrow(tokenise(distinct, config.max_ngram_length), schema)


def entry_counts(corpus: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """(doc_id, n_entries): how many n-grams each document has, every occurrence counted."""
    rows = spread(corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "content"))
    return rows.mapInArrow(count_ngrams(config.max_ngram_length), "doc_id long, n_entries long")


@dataclass
class Index:
    """``postings`` (ngram_hash, chunk, n_docs, doc_ids), ``docs`` (doc_id, root, path), ``terms`` (ngram_hash, df).

    ``stale`` (doc_id) are documents that postings and terms still know, but docs do not. ``texts``
    (doc_id, root, path, content) are the documents, if they were stored with the index.
    """

    config: IndexConfig
    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    commit: str | None = None
    stale: DataFrame | None = None
    texts: DataFrame | None = None
    #: Whether the partitions of the postings are ranges of hashes.
    ordered: bool = False

    def stats(self) -> DataFrame:
        """One row: file_count, ngram_count (distinct hashes), posting_count (hash and document pairs)."""
        files = self.docs.agg(F.count(F.lit(1)).alias("file_count"))
        terms = self.terms if self.stale is None else P.document_frequency(_packed(self))
        grams = terms.agg(F.countDistinct("ngram_hash").alias("ngram_count"), F.coalesce(F.sum("df"), F.lit(0)).alias("posting_count"))
        return files.join(F.broadcast(grams))  # one row each

    def live(self, ids: DataFrame) -> DataFrame:
        """``ids`` (doc_id) without those that are gone."""
        return ids if self.stale is None else ids.join(self.stale, "doc_id", "left_anti")

    def lookup(self, ngram_hash: int) -> DataFrame:
        """The documents of one hash; the filter reaches the scan, which skips by row group."""
        return self.live(P.unpack(self.postings.where(F.col("ngram_hash") == ngram_hash)).select("doc_id"))

    def frequencies(self, hashes: frozenset[int]) -> dict[int, int]:
        """In how many documents, gone ones included, each of a pattern's few hashes is."""
        out: dict[int, int] = {}
        if hashes:
            for r in self.terms.where(F.col("ngram_hash").isin(sorted(hashes))).collect():  # a row per hash and segment
                out[r["ngram_hash"]] = out.get(r["ngram_hash"], 0) + r["df"]
        return out

    def save(self, path: str, commit: str | None = None, texts: DataFrame | None = None) -> int:
        """Write the index as the next version below ``path``; readers see it whole or not at all.

        With ``texts``, the corpus, the documents are stored too, so that a search reads no more
        of them than the pages that hold candidates.
        """
        whole = compact(self) if self.stale is not None else self
        return _publish(self.postings.sparkSession, path, whole, [], commit or self.commit, None, texts)


def _publish(spark: SparkSession, path: str, part: Index, before: list[str], commit: str | None, stale: DataFrame | None, texts: DataFrame | None) -> int:
    """Writes a segment, and commits the version that it makes with those before it."""
    folder = f"index-{uuid.uuid4().hex}"
    ranges = part.postings if part.ordered else part.postings.repartitionByRange("ngram_hash")
    ranges.sortWithinPartitions("ngram_hash", "chunk").write.options(**_DELTAS).parquet(f"{path}/{folder}/postings")
    part.terms.repartitionByRange("ngram_hash").sortWithinPartitions("ngram_hash").write.options(**_DELTAS).parquet(f"{path}/{folder}/terms")
    part.docs.write.parquet(f"{path}/{folder}/docs")
    if stale is not None:
        stale.select("doc_id").write.parquet(f"{path}/{folder}/stale")
    if texts is not None:
        texts.select("doc_id", "root", "path", "content").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.options(**_PAGES).parquet(f"{path}/{folder}/texts")
    meta = {"format": FORMAT, "commit": (commit or "").strip() or None, "config": asdict(part.config), "segments": [*before, folder], "stale": stale is not None, "texts": texts is not None}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{path}/{folder}/meta")
    return Versions(spark, path).commit(folder)


def _meta(spark: SparkSession, at: str) -> dict:
    return json.loads(spark.read.parquet(f"{at}/meta").first()["meta"])


def append(spark: SparkSession, path: str, delta: Index, stale: DataFrame, commit: str | None = None, texts: DataFrame | None = None) -> int:
    """The next version below ``path``: the latest one, without the documents of ``stale`` (doc_id), plus ``delta``.

    Nothing of the earlier segments is read or written. ``texts`` holds the documents of ``delta`` and
    is needed where the index has texts.
    """
    found = Versions(spark, path).list()
    if not found:
        raise FileNotFoundError(f"no index below {path}")
    meta = _meta(spark, f"{path}/{found[-1][1]}")
    if IndexConfig(**meta["config"]) != delta.config:
        raise ValueError("indexes of different configurations can't be merged")
    if meta["texts"] and texts is None:
        raise ValueError("the index has texts; give those of the new documents")
    return _publish(spark, path, delta, meta["segments"], commit or delta.commit or meta["commit"], stale, texts if meta["texts"] else None)


def index_postings(corpus: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """(ngram_hash, chunk, n_docs, doc_ids): what ``pack`` makes of the entries, without a row for each.

    The partitions are ranges of hashes in their order.
    """
    n = max(4 * parallelism(corpus.sparkSession), estimated_bytes(corpus) // BUCKET_BYTES)
    bits = min(MAX_BITS, max(1, int(n - 1).bit_length()))
    rows = spread(corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "content"))
    packed = rows.mapInArrow(tokenise_packed(bits, config.max_ngram_length), "bucket long, span long, data binary")
    parts = min(1 << bits, max(parallelism(corpus.sparkSession), (1 << bits) // 4))
    placed = packed.repartitionById(parts, F.floor(F.col("bucket") * parts / (1 << bits)).cast("int"))
    return placed.sortWithinPartitions("bucket", "span").mapInArrow(unpack_lists(P.CHUNK.bit_length() - 1), _POSTINGS)


def build(corpus: DataFrame, config: IndexConfig = IndexConfig(), docs: DataFrame | None = None) -> Index:
    """The index of a corpus (doc_id, root, path, content). Repeated rows of a document count once.

    The postings are computed once, into the shared folder. ``docs`` (doc_id, root, path) spares a
    second look at the corpus where its documents are listed already.
    """
    packed = stored(index_postings(corpus, config), "postings", **_DELTAS)
    docs = corpus.select("doc_id", "root", "path").distinct() if docs is None else docs
    return Index(config, packed, docs, P.document_frequency(packed), ordered=True)


def open_index(spark: SparkSession, path: str) -> Index:
    """The latest committed version below ``path``."""
    found = Versions(spark, path).list()
    if not found:
        raise FileNotFoundError(f"no index below {path}")
    meta = _meta(spark, f"{path}/{found[-1][1]}")
    if meta["format"] != FORMAT:
        raise ValueError(f"index format {meta['format']} is not {FORMAT}")
    segments = [f"{path}/{s}" for s in meta["segments"]]
    read = lambda name, some=segments: spark.read.option("mergeSchema", name == "docs").parquet(*(f"{s}/{name}" for s in some))
    stale = read("stale", segments[1:]) if len(segments) > 1 else None
    docs, texts = read("docs"), read("texts") if meta["texts"] else None
    if stale is not None:
        docs, texts = (x and x.join(stale, "doc_id", "left_anti") for x in (docs, texts))
    return Index(IndexConfig(**meta["config"]), read("postings"), docs, read("terms"), meta["commit"], stale, texts)


def _packed(index: Index) -> DataFrame:
    kept = P.unpack(index.postings)
    return P.pack(kept if index.stale is None else kept.join(index.stale, "doc_id", "left_anti"))


def compact(index: Index) -> Index:
    """The same index as one segment that knows nothing of documents that are gone."""
    packed = stored(_packed(index), "postings")
    return Index(index.config, packed, index.docs, P.document_frequency(packed), index.commit, None, index.texts)


def merge(base: Index, delta: Index, stale: DataFrame | None = None) -> Index:
    """``base`` without the documents of ``stale`` (doc_id), plus ``delta``; both have one configuration.

    The postings of both stand side by side: nothing is shuffled but ids against those that are gone.
    """
    if base.config != delta.config:
        raise ValueError("indexes of different configurations can't be merged")
    gone, docs = base.stale, base.docs
    if stale is not None:
        gone = stale.select("doc_id") if gone is None else gone.unionByName(stale.select("doc_id"))
        docs = docs.join(stale.select("doc_id"), "doc_id", "left_anti")
    return Index(base.config, base.postings.unionByName(delta.postings), docs.unionByName(delta.docs, allowMissingColumns=True), base.terms.unionByName(delta.terms), delta.commit or base.commit, gone)
