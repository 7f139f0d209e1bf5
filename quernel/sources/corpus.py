"""Corpora: (doc_id, root, path, content) frames from directories or tables, and scan filters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.runtime import numbered, parallelism, stored
from quernel.sources import walk
from quernel.sources.ignore import user_rules

#: A file is binary if one of so many first bytes is 0.
BINARY_WINDOW = 16_384
LINE_END = "\r?\n"
#: Bytes of files that one task reads, and bytes below which it isn't worth another task.
FILE_BYTES, SMALL_BYTES = 128 << 20, 1 << 20


@dataclass(frozen=True)
class IndexConfig:
    """What an index was built with; it is stored with it and read by its queries."""

    max_ngram_length: int = 16
    max_file_size: int = 50 * 1024 * 1024
    skip_binary: bool = True


def is_small(size: Column, config: IndexConfig = IndexConfig()) -> Column:
    """Not larger than the limit; an unknown size is kept."""
    return size.isNull() | (size <= config.max_file_size)


def is_text(content: Column) -> Column:
    """No zero byte among the first bytes; unreadable (null) content is kept."""
    return content.isNull() | (F.position(F.unhex(F.lit("00")), F.substring(content, 1, BINARY_WINDOW)) == 0)


def is_visible(path: Column) -> Column:
    """No part of the path starts with a dot."""
    return ~F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))


def path_order(path: Column) -> Column:
    """Sort key that orders paths by their components: ``a/b`` before ``a.txt``."""
    return F.split(path, "/")


def to_text(content: Column) -> Column:
    """Bytes as text, invalid UTF-8 being replaced."""
    return F.make_valid_utf8(content.cast("string"))


def lines(text: Column) -> Column:
    """The lines of a text: ends are ``\\n`` or ``\\r\\n``, and the last line need not have one."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def from_table(df: DataFrame, doc_id: str, path: Column | str, content: str, root: Column | str | None = None) -> DataFrame:
    """A corpus from a table. Text columns are taken as UTF-8; null content is empty; of a repeated
    doc_id one row is kept, which should be the same in each."""
    body = F.col(content) if dict(df.dtypes)[content] == "binary" else F.encode(F.col(content), "UTF-8")
    path = F.col(path) if isinstance(path, str) else path
    root = F.lit("") if root is None else F.col(root) if isinstance(root, str) else root
    return df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), root.cast("string").alias("root"), path.alias("path"), F.coalesce(body, F.lit(b"")).alias("content"))


def listing(spark: SparkSession, roots: Iterable[str], config: IndexConfig = IndexConfig()) -> DataFrame:
    """(doc_id, root, path, location, size) of the files below the roots; paths are relative to their own root.

    Hidden files, files that ignore files name, links and what lies below linked folders, files
    above the size limit and binary files are left out, whatever else they are called. Ids follow
    the order of roots and paths. A root that is a file is one file named by its base name.
    ``location`` is a path's bytes, of which ``path`` may be no faithful text. The tasks list the
    trees, once; the result is stored.
    """
    roots = list(roots)
    if not roots:
        raise ValueError("no root")
    user = user_rules()
    parts: list[tuple[int, str, bytes, bool]] = []
    for n, root in enumerate(roots):
        t = walk.tree(root, user)
        if not t.exists():
            raise FileNotFoundError(f"no file or folder {root}")
        parts += [(n, root, b"", False)] if t.is_file() else [(n, root, at, deep) for at, deep in walk.subtrees(t)]
    work = spark.createDataFrame(parts, "n int, root string, at binary, deep boolean").repartition(min(len(parts), 8 * parallelism(spark)))
    found = work.mapInArrow(walk.lister(config.max_file_size, BINARY_WINDOW if config.skip_binary else 0, user), "n int, root string, path string, location binary, size long")
    dense = numbered(found.orderBy("n", path_order(F.col("path")), "location"), "doc_id", "paths")
    return stored(dense.select("doc_id", "root", "path", "location", "size"), "listing")


def contents(docs: DataFrame) -> DataFrame:
    """(doc_id, root, path, content) of listed documents (doc_id, root, path, maybe location), opened when the result is read.

    Only names are shuffled. Contents that cannot be read any more are null.
    """
    spark = docs.sparkSession
    location = F.col("location") if "location" in docs.columns else F.encode("path", "UTF-8")
    if "size" in docs.columns:  # a whole listing: equal shares of bytes, ids in order
        total = docs.agg(F.sum("size")).first()[0] or 0
        docs = docs.repartitionByRange(int(max(1, min(total // FILE_BYTES, 100_000), min(parallelism(spark), total // SMALL_BYTES))), "doc_id")
    else:
        docs = docs.repartition(parallelism(spark), "doc_id")
    return docs.select("doc_id", "root", "path", location.alias("location")).mapInArrow(walk.read_contents, "doc_id long, root string, path string, content binary")


def from_directories(spark: SparkSession, roots: Iterable[str], config: IndexConfig = IndexConfig()) -> DataFrame:
    """A corpus of the files below the roots, as ``listing`` finds them."""
    return contents(listing(spark, roots, config))
