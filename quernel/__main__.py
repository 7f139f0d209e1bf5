"""Command line: ``python -m quernel index PATH…`` and ``python -m quernel search PATTERN [PATH]``.

``search`` prints matching lines as path:line and ends with 0 if there are any, 1 if not and 2 on error.
"""

from __future__ import annotations

import argparse
import os
import sys
import threading
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quernel.operators import overlay
from quernel.operators.index import build, open_index
from quernel.operators.search import Searcher, formatted, ordered
from quernel.sources import corpus as C
from quernel.sources.git import changes_since, head_commit

FOLDER = ".quernel"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quernel", description="Indexed regular-expression search.")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="index directories or files")
    i.add_argument("paths", nargs="+")
    i.add_argument("-o", "--output-dir", help=f"where the index goes (default: {FOLDER} in the first path)")
    i.add_argument("--max-file-size", type=int, default=C.IndexConfig.max_file_size, help="larger files are left out")
    i.add_argument("-v", "--verbose", action="store_true")
    s = sub.add_parser("search", help="search indexed files")
    s.add_argument("pattern")
    s.add_argument("path", nargs="?", default=".")
    s.add_argument("--index-dir", help=f"where the index is (default: {FOLDER} in the path)")
    s.add_argument("-l", "--files-with-matches", action="store_true", help="paths only; goes before -c and -n")
    s.add_argument("-c", "--count", action="store_true", help="matching lines per file; goes before -n")
    s.add_argument("-n", "--line-number", action="store_true")
    s.add_argument("-i", "--ignore-case", action="store_true")
    s.add_argument("-f", "--file-filter", help="pattern that paths must match")
    s.add_argument("--fresh", action="store_true", help="also search what changed since the indexed commit")
    return p


def _session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is not None:
        return found
    spark = SparkSession.builder.appName("quernel").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _commit(path: str) -> str | None:
    try:
        return head_commit(path)
    except (RuntimeError, OSError):
        return None


@contextmanager
def _progress(spark: SparkSession, shown: bool) -> Iterator[None]:
    """Says twice a second how far the running stages are."""
    over = threading.Event()

    def tell() -> None:
        tracker, began = spark.sparkContext.statusTracker(), time.time()
        while not over.wait(0.5):
            stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
            done, of = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
            if of:
                print(f"{time.time() - began:.0f} s: {done} of {of} tasks of the running stages done", file=sys.stderr, flush=True)

    teller = threading.Thread(target=tell, daemon=True)
    if shown:
        teller.start()
    try:
        yield
    finally:
        over.set()
        if shown:
            teller.join()


def _index(spark: SparkSession, args: argparse.Namespace) -> int:
    config = C.IndexConfig(max_file_size=args.max_file_size)
    roots = [os.path.abspath(p) for p in args.paths]
    base = roots[0] if os.path.isdir(roots[0]) else os.path.dirname(roots[0])
    out = args.output_dir or os.path.join(base, FOLDER)
    with _progress(spark, args.verbose):
        files = C.listing(spark, roots, config)
        if args.verbose:
            found = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
            print(f"{found['n']} files with {found['size'] / 1e6:.1f} MB to index", file=sys.stderr)
        index = build(C.contents(files), config, files.drop("size"))
        version = index.save(os.path.abspath(out), commit=_commit(base))
        stats = index.stats().first()
    if args.verbose:
        print(f"version {version} in {out}", file=sys.stderr)
    print(f"{stats['file_count']} files, {stats['ngram_count']} n-grams", file=sys.stderr)
    return 0


def _search(spark: SparkSession, args: argparse.Namespace) -> int:
    root = os.path.abspath(args.path)
    index = open_index(spark, os.path.abspath(args.index_dir or os.path.join(root, FOLDER)))
    s = Searcher(None, index, fetch=C.contents)  # candidates are opened as they are now
    options = {"ignore_case": args.ignore_case, "path_filter": args.file_filter}
    if args.fresh and index.commit:
        changes = changes_since(spark, root, index.commit).withColumn("root", F.lit(root))
        now = C.from_directories(spark, [root], index.config)
        lines = overlay.search_with_overlay(s, now, changes, args.pattern, args.ignore_case)
        if args.file_filter:
            from quernel.plans.java import to_java

            lines = lines.where(F.col("path").rlike(to_java(args.file_filter)))
        if args.files_with_matches:
            hits = lines.select("root", "path").distinct()
        elif args.count:
            hits = lines.groupBy("root", "path").agg(F.count(F.lit(1)).alias("n"))
        else:
            hits = lines
    elif args.files_with_matches:
        hits = s.files(args.pattern, **options)
    else:
        hits = s.counts(args.pattern, **options) if args.count else s.lines(args.pattern, **options)
    found = False
    for r in formatted(ordered(hits), args.line_number).toLocalIterator():
        print(r["result"])
        found = True
    return 0 if found else 1


def main(argv: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return (_index if args.command == "index" else _search)(_session(), args)
    except Exception as e:  # noqa: BLE001
        print(f"quernel: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
