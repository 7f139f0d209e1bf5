"""Queries of the search engine's own operators, over whole tables, and their SQL."""

from __future__ import annotations

import atexit
import os
import shutil
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import codec
from quernel.functions.trigrams import byte_hash, may_follow, may_precede, trigram_entries, trigram_hash, trigram_masks, trigrams
from quernel.functions.weights import RANKS
from quernel.operators import overlay, postings
from quernel.operators.index import build, compact, entry_counts, index_entries, open_index
from quernel.operators.search import Searcher, formatted, ordered
from quernel.runtime import numbered, scratch_path, stored, table
from quernel.sources import corpus as C
from quernel.sources.git import changes_since, head_commit
from quernel.streaming.delta_index import index_stream, indexed_entries

#: Path of a document: its source, language and id.
_PATH = "concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), cast(doc_id as string))"
_indexes: dict[tuple[str, str], Searcher] = {}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return C.from_table(table(spark, sf, "documents"), "doc_id", F.expr(_PATH), "text")


def searcher(spark: SparkSession, sf: str) -> Searcher:
    """A searcher over the documents with a stored index, built once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        path = scratch_path(spark, "index")
        docs = documents(spark, sf)
        build(docs).save(path, texts=docs)
        _indexes[key] = Searcher(docs, open_index(spark, path))
    return _indexes[key]


def indexed(spark: SparkSession, sf: str) -> Searcher:
    """A searcher over the documents that were stored with the index."""
    index = searcher(spark, sf).index
    return Searcher(index.texts, index)


def _lines(pattern: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return searcher(spark, sf).lines(pattern, **options).select("doc_id", "path", F.col("line_number").cast("long").alias("line_number"), "line")

    return query


def _files(pattern: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: searcher(spark, sf).files(pattern, **options).select("doc_id", "path")


def _counts(pattern: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: searcher(spark, sf).counts(pattern, **options).select("path", "n")


_DOCS = r"""
d as (select doc_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), doc_id::varchar) as path, string_split_regex(text, '\r?\n') as s from documents),
u as (select doc_id, path, unnest(s) as line, generate_subscripts(s, 1)::bigint as line_number, len(s) as n from d),
l as (select doc_id, path, line_number, line from u where not (line_number = n and line = ''))
"""


def _sql_lines(where: str, what: str = "doc_id, path, line_number, line", rest: str = "") -> str:
    return f"with {_DOCS} select {what} from l where {where} {rest}"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _re(pattern: str, options: str = "") -> str:
    return f"regexp_matches(line, '{_quoted(pattern)}'" + (f", '{options}')" if options else ")")


#: name: (pattern, same in RE2, options of the search, options of RE2)
_LINE_SEARCHES = {
    "search_literal": ("piezoelectric", "piezoelectric", {}, ""),
    "search_wildcard": ("the.*ing (s|c)", "the.*ing (s|c)", {}, ""),
    "search_alternation": ("graphite|borosilicate", "graphite|borosilicate", {}, ""),
    "search_class": ("[Cc]laims? [2-4]", "[Cc]laims? [2-4]", {}, ""),
    "search_repetition": ("(0[0-9]{3})[^a-z]+[Pp]re", "(0[0-9]{3})[^a-z]+[Pp]re", {}, ""),
    "search_anchor": ("^CLAIMS$", "^CLAIMS$", {}, ""),
    "search_short_literal": ("of", "of", {}, ""),
    "search_two_bytes_in_group": (r"is (an?|of) ", "is (an?|of) ", {}, ""),
    "search_ignore_case": ("ABSTRACT", "ABSTRACT", {"ignore_case": True}, "i"),
    "search_ignore_case_unicode": ("ÖFFNUNG", "ÖFFNUNG", {"ignore_case": True}, "i"),
    "search_inline_ignore_case": ("(?i)kelvin|SILICONE", "(?i)kelvin|SILICONE", {}, ""),
    "search_negated_class": ("mm[^,;a-z ]", "mm[^,;a-z ]", {}, ""),
    "search_lazy_and_counted": ("a{2,3}|b.*?c{2}", "a{2,3}|b.*?c{2}", {}, ""),
    "search_escapes": (r"\x28 Math\. \d+ \)", r"\( Math\. [0-9]+ \)", {}, ""),
    "search_empty_pattern": ("", "", {}, ""),
    "search_match_all": (".*", ".*", {}, ""),
    "search_no_match": ("nonexistent_string_xyz_123", "nonexistent_string_xyz_123", {}, ""),
}


#: Searches that may not fall back to a scan; their candidates are a small part of the documents.
_INDEXED = {
    "indexed_literal": ("ultrasonic latch", "ultrasonic latch", {}, ""),
    "indexed_alternation": ("ultrasonic latch|helical film|zinc oxide plate", "ultrasonic latch|helical film|zinc oxide plate", {}, ""),
    "indexed_class": ("[Uu]ltrasonic (?:latch|lens)[ ,.]", "[Uu]ltrasonic (latch|lens)[ ,.]", {}, ""),
    "indexed_repetition": ("piezo(?:electric)+ +film", "piezo(?:electric)+ +film", {}, ""),
    "indexed_exact_repetition": ("x{0}absorbent prism", "absorbent prism", {}, ""),
    "indexed_look": (r"\bpiezoelectric latch\b", r"\bpiezoelectric latch\b", {}, ""),
    "indexed_capture": (r"(?P<part>ultrasonic) (?:latch|lens)s?", "ultrasonic (latch|lens)s?", {}, ""),
    "indexed_nested_and": ("piezoelectric (valve|lever|drum)", "piezoelectric (valve|lever|drum)", {}, ""),
    "indexed_nested_or": (r"piezoelectric (valve|lever)|glass (?:wool|fibre) and absorbent|\( Math\. [0-9]+ \)", r"piezoelectric (valve|lever)|glass (?:wool|fibre) and absorbent|\( Math\. [0-9]+ \)", {}, ""),
    "indexed_wildcard": (r"between \d+ and \d+ laminated", "between [0-9]+ and [0-9]+ laminated", {}, ""),
    "indexed_gap": ("ultrasonic [a-z]+ [0-9]+ is mounted on the piezoelectric", "ultrasonic [a-z]+ [0-9]+ is mounted on the piezoelectric", {}, ""),
    "indexed_ignore_case": ("ÖFFNUNG", "ÖFFNUNG", {"ignore_case": True}, "i"),
    "indexed_inline_ignore_case": ("(?i)PIEZOELECTRIC lever", "piezoelectric lever", {}, "i"),
    "indexed_none": ("ultrasonic xylophone", "ultrasonic xylophone", {}, ""),
}


def _indexed(pattern: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return indexed(spark, sf).lines(pattern, use_index=True, **options).select("doc_id", "path", F.col("line_number").cast("long").alias("line_number"), "line")

    return query


def indexed_files_ignore_case(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(spark, sf).files("PIEZOELECTRIC Lever", ignore_case=True, use_index=True).select("doc_id", "path")


def indexed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(spark, sf).counts("ultrasonic (latch|lens)", use_index=True).select("path", "n")


def indexed_file_filter(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(spark, sf).lines("piezoelectric (valve|lever|film)", path_filter="^[a-m].*/en/", use_index=True).select("path", "line")


def search_full_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same answer without the index."""
    return _lines("the.*ing (s|c)", use_index=False)(spark, sf)


def search_exists(spark: SparkSession, sf: str) -> DataFrame:
    s = searcher(spark, sf)
    found = [(p, s.exists(p)) for p in ("graphite", "nonexistent_string_xyz_123")]
    return spark.createDataFrame(found, "pattern string, found boolean")


def search_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a match, each with its place in path order."""
    hits = ordered(searcher(spark, sf).files("graphite"))
    return numbered(hits, "place", "ordered").select("path", (F.col("place") + 1).alias("place"))


def search_formatted(spark: SparkSession, sf: str) -> DataFrame:
    return formatted(searcher(spark, sf).lines("graphite"), line_numbers=True)


def candidates_missed(spark: SparkSession, sf: str) -> DataFrame:
    """Per pattern, the documents with a matching line, those of them that the index does not give (there
    must be none), and whether it gives fewer than a third of all documents."""
    s, rows = indexed(spark, sf), None
    n = s.n_docs()
    for p, _, options, _ in _INDEXED.values():
        found = s.candidates(p, use_index=True, **options).withColumn("is_candidate", F.lit(1))
        both = s.files(p, use_index=False, **options).select("doc_id", F.lit(1).alias("matches")).join(found, "doc_id", "full_outer")
        sums = both.agg(F.count("matches").alias("n_matching"), F.count(F.when(F.col("is_candidate").isNull(), 1)).alias("n_missed"), (F.count("is_candidate") < n / 3).alias("is_selective"))
        one = sums.select(F.lit(p).alias("pattern"), "n_matching", "n_missed", "is_selective")
        rows = one if rows is None else rows.unionByName(one)
    return rows


_GRAM = "lpad(hex(trigram), 6, '0')"


def trigram_counts(spark: SparkSession, sf: str) -> DataFrame:
    grams = trigram_entries(documents(spark, sf), "doc_id", "content")
    return grams.groupBy("trigram").agg(F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_docs")).withColumn("trigram", F.expr(_GRAM))


def trigram_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every window in order, as a native array: its length and ends per test item."""
    t = _items(spark, sf).select(F.col("doc_id").alias("item_id"), trigrams(F.col("content")).alias("t"))
    return t.select("item_id", F.size("t").cast("long").alias("n"), F.hex(F.element_at("t", 1)).alias("first"), F.hex(F.element_at("t", -1)).alias("last"))


def trigram_document_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every window of each document in order: how many there are, the first and the last."""
    t = documents(spark, sf).select("doc_id", trigrams(F.col("content")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.hex(F.element_at("t", 1)).alias("first"), F.hex(F.element_at("t", -1)).alias("last"))


def trigram_loc_mask(spark: SparkSession, sf: str) -> DataFrame:
    masks = trigram_masks(documents(spark, sf), "doc_id", "content")
    return masks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_trigrams"), F.sum("loc_mask").cast("long").alias("sum_loc"))


def trigram_next_mask(spark: SparkSession, sf: str) -> DataFrame:
    masks = trigram_masks(documents(spark, sf), "doc_id", "content")
    return masks.groupBy("doc_id").agg(F.sum("next_mask").cast("long").alias("sum_next"), F.max("next_mask").alias("max_next"))


def trigram_next_char(spark: SparkSession, sf: str) -> DataFrame:
    """Per document, how many of its trigrams may be followed by a space, as their masks say."""
    masks = trigram_masks(documents(spark, sf), "doc_id", "content")
    space = byte_hash(F.lit(b" "), F.lit(1))
    return masks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_trigrams"), F.sum(may_precede(F.col("next_mask"), space).cast("long")).alias("n_before_space"))


def trigram_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Every trigram of the documents with its hash."""
    grams = trigram_entries(documents(spark, sf), "doc_id", "content").select("trigram").distinct()
    return grams.select(F.expr(_GRAM).alias("trigram"), trigram_hash(F.unhex(F.expr(_GRAM))).alias("hash"))


def trigram_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """Per document, in how many of its trigrams' neighbours by text the masks allow the place."""
    m = trigram_masks(documents(spark, sf), "doc_id", "content").select("doc_id", "trigram", "loc_mask")
    a = m.select("doc_id", F.substring("trigram", 2, 2).alias("inner"), F.col("loc_mask").alias("la"))
    b = m.select("doc_id", F.substring("trigram", 1, 2).alias("inner"), F.col("loc_mask").alias("lb"))
    return a.join(b, ["doc_id", "inner"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(may_follow(F.col("la"), F.col("lb")).cast("long")).alias("n_adjacent"))


def trigram_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted index by trigram: each one's documents."""
    packed = postings.pack(trigram_entries(documents(spark, sf), "doc_id", "content"), "trigram")
    return packed.select(F.expr(_GRAM).alias("trigram"), F.col("chunk").cast("long").alias("chunk"), F.col("n_docs").cast("long").alias("n_docs"), F.array_join("doc_ids", ",").alias("doc_ids"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ngram_entry").where("ngram_hash is not null and doc_id is not null").select("ngram_hash", "doc_id")


def posting_df(spark: SparkSession, sf: str) -> DataFrame:
    return postings.document_frequency(postings.pack(_entries(spark, sf)))


#: Hashes of n-grams that occur in many files of the table.
_A, _B, _C = 2854292027, 3782388606, 2118852570


def _list(spark: SparkSession, sf: str, h: int) -> DataFrame:
    return _entries(spark, sf).where(F.col("ngram_hash") == h).select("doc_id")


def posting_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return postings.intersect(_list(spark, sf, _A), _list(spark, sf, _B))


def posting_union(spark: SparkSession, sf: str) -> DataFrame:
    return postings.union(_list(spark, sf, _A), _list(spark, sf, _B))


def posting_subtract(spark: SparkSession, sf: str) -> DataFrame:
    return postings.subtract(_list(spark, sf, _A), _list(spark, sf, _B))


def posting_intersect_many(spark: SparkSession, sf: str) -> DataFrame:
    return postings.holding_all(_entries(spark, sf), [_A, _B, _C])


def posting_union_many(spark: SparkSession, sf: str) -> DataFrame:
    return postings.holding_any(_entries(spark, sf), [_A, _B, _C])


def posting_delta_encode(spark: SparkSession, sf: str) -> DataFrame:
    return codec.delta_encode(_entries(spark, sf))


def posting_delta_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Decoding what was encoded gives each hash's documents back."""
    d = codec.delta_encode(_entries(spark, sf)).withColumnRenamed("doc_id", "rank")
    return codec.delta_decode(d).select("ngram_hash", "doc_id")


def posting_varint(spark: SparkSession, sf: str) -> DataFrame:
    """Each hash's documents in the byte form: how many bytes they take, and what is decoded from them."""
    packed = stored(postings.pack(_entries(spark, sf)), "packed")
    coded = stored(codec.encode_lists(packed), "coded")
    size = coded.groupBy("ngram_hash").agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum(F.length("data")).alias("n_bytes"))
    head = sum((F.when(F.col("n_docs") >= (1 << 7 * k), 1).otherwise(0) for k in range(1, 5)), F.lit(1))
    back = codec.decode_lists(coded).select("ngram_hash", F.explode("doc_ids").alias("doc_id")).groupBy("ngram_hash").agg(F.sum("doc_id").alias("sum_ids"), F.max("doc_id").alias("last_id"))
    return size.join(back, "ngram_hash").select("ngram_hash", "n_docs", (F.col("n_bytes") + head).alias("n_bytes"), "sum_ids", "last_id")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return C.from_table(table(spark, sf, "eval_item"), "item_id", F.col("suite"), "text")


def ngram_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse n-grams of each test item: how many, and the sum of their positions."""
    entries = index_entries(_items(spark, sf), distinct=False)
    return entries.groupBy(F.col("doc_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n_entries"), F.sum("pos").alias("sum_pos"))


def ngram_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse n-grams of each document: how many, and the sum of their positions."""
    entries = index_entries(documents(spark, sf), distinct=False)
    return entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("pos").alias("sum_pos"))


def index_entry_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of each document, every occurrence counted; documents without any have 0."""
    return entry_counts(documents(spark, sf))


def ngram_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Index entries per document."""
    entries = index_entries(documents(spark, sf))
    return entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hashes"), F.min("ngram_hash").alias("least"), F.max("ngram_hash").alias("greatest"))


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return build(_items(spark, sf)).stats()


def index_stats_documents(spark: SparkSession, sf: str) -> DataFrame:
    return build(documents(spark, sf)).stats()


def index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the n-gram ``the`` (lower case, any context)."""
    import zlib

    return searcher(spark, sf).index.lookup(zlib.crc32(b"the"))


def index_commit(spark: SparkSession, sf: str) -> DataFrame:
    """The commit that an index of the test items was stamped with, as it is read back: the newest good one."""
    runs = table(spark, sf, "index_meta").where("trim(coalesce(commit_sha, '')) <> '' and finished_at is not null")
    newest = runs.orderBy(F.desc("started_at"), "root_id", "run_id").select("commit_sha").first()
    path = scratch_path(spark, "stamped")
    build(_items(spark, sf)).save(path, commit=newest[0] + "\n" if newest else None)
    return spark.createDataFrame([(open_index(spark, path).commit,)], "commit_sha string")


def _files_of_items(spark: SparkSession, sf: str, name: str) -> tuple[str, dict[str, int]]:
    """A local folder with a file for each test item, and each file's item."""
    path, out = scratch_path(spark, name).removeprefix("file:"), {}
    path = "/" + path.lstrip("/")
    atexit.register(shutil.rmtree, path, True)
    items = table(spark, sf, "eval_item").where("item_id is not null").select("suite", "item_id", "text").distinct().collect()  # a fixed table of a few hundred rows
    for r in items:
        file = os.path.join(r["suite"] or "none", "_of" if r["item_id"] % 2 else "of", f"{r['item_id']:08d}.txt")
        os.makedirs(os.path.dirname(os.path.join(path, file)), exist_ok=True)
        with open(os.path.join(path, file), "w", encoding="utf-8", newline="") as f:
            f.write(r["text"] or "")
        out[file] = r["item_id"]
    return path, out


def overlay_git(spark: SparkSession, sf: str) -> DataFrame:
    """What git says has changed since a commit: files changed and committed, changed, removed, renamed and added since."""
    path, files = _files_of_items(spark, sf, "repository")
    git = lambda *a: subprocess.run(["git", "-C", path, "-c", "user.name=a", "-c", "user.email=a@b", "-c", "commit.gpgsign=false", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    base = head_commit(path)
    for when in (2, 4):  # the second half of the changes is not committed
        for name, k in sorted(files.items()):
            at = os.path.join(path, name)
            if k % 10 in (when, when + 1):
                with open(at, "a", encoding="utf-8") as f:
                    f.write("changed")
            elif k % 10 == when + 4:
                os.remove(at)
            elif k % 10 == when + 5:
                with open(at + ".new", "w", encoding="utf-8") as f:
                    f.write("new")
        if when == 2:
            git("add", "-A")
            git("commit", "-qm", "second")
    return changes_since(spark, path, base)


def scan_roots(spark: SparkSession, sf: str) -> DataFrame:
    """A scan of several roots: the test items as files, a folder for each suite."""
    path, _ = _files_of_items(spark, sf, "roots")
    found = C.from_directories(spark, sorted(e.path for e in os.scandir(path)))
    return found.select("doc_id", F.element_at(F.split("root", "/"), -1).alias("suite"), "path", F.length("content").cast("long").alias("size"))


def _second(spark: SparkSession, sf: str) -> DataFrame:
    """A later state of the documents: every tenth is gone, every other tenth changed, others are new."""
    d = documents(spark, sf)
    kept = d.where("doc_id % 10 <> 3").withColumn("content", F.when(F.expr("doc_id % 10 = 7"), F.concat("content", F.lit(b"\ngraphite changed"))).otherwise(F.col("content")))
    new = d.where("doc_id % 10 = 5").select((-F.col("doc_id")).alias("doc_id"), "root", F.concat("path", F.lit(".new")).alias("path"), "content")
    return kept.unionByName(new)


def overlay_detect(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.detect_changes(documents(spark, sf), _second(spark, sf)).select("path", "status")


def overlay_search(spark: SparkSession, sf: str) -> DataFrame:
    """Matching lines of the later state from the earlier index and the changes."""
    after = _second(spark, sf)
    changes = stored(overlay.detect_changes(documents(spark, sf), after), "changes")
    return overlay.search_with_overlay(searcher(spark, sf), after, changes, "graphite").select("path", F.col("line_number").cast("long").alias("line_number"), "line")


def _renumbered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The later state, in which changed documents have new ids, and the changes."""
    after = _second(spark, sf).withColumn("doc_id", F.when(F.expr("doc_id % 10 = 7"), F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")))
    return after, stored(overlay.detect_changes(documents(spark, sf), after), "changes")


def overlay_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the refreshed index that may hold the pattern and do."""
    after, changes = _renumbered(spark, sf)
    fresh = overlay.refresh(searcher(spark, sf).index, after, changes)
    return Searcher(after, fresh).files("graphite", use_index=True).select("path")


def overlay_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The same of a stored index, to which a segment of the changes was added, read with the index's own texts."""
    docs = documents(spark, sf)
    path = scratch_path(spark, "segments")
    build(docs).save(path, texts=docs)
    overlay.refresh_stored(spark, path, *_renumbered(spark, sf))
    index = open_index(spark, path)
    return Searcher(index.texts, index).files("graphite", use_index=True).select("path")


def overlay_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of an n-gram in the refreshed index after its segments were made one."""
    import zlib

    after, changes = _renumbered(spark, sf)
    whole = compact(overlay.refresh(searcher(spark, sf).index, after, changes))
    return whole.lookup(zlib.crc32(b"the")).join(whole.docs, "doc_id").select("path")


def filter_binary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_file").where(C.is_text(F.col("content"))).select("doc_id", "path").distinct()


def filter_size(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_file").where(C.is_small(F.col("size_bytes"), C.IndexConfig(max_file_size=2500))).select("doc_id", "size_bytes").distinct()


def filter_hidden(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_file").where(C.is_visible(F.col("path"))).select("doc_id", "path").distinct()


def corpus_todo_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed search over source files, whose bytes are partly no UTF-8."""
    files = C.from_table(table(spark, sf, "corpus_file").dropDuplicates(["doc_id"]), "doc_id", "path", "content", "root_id")
    return Searcher(files, build(files)).lines(r"(TODO|FIXME)\b.*\bleaks", use_index=True).select("doc_id", "path", "line_number", "line")


def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """Entries per document, indexed by a stream."""
    rows = table(spark, sf, "documents")
    path = scratch_path(spark, "stream")
    reader = spark.readStream.schema(rows.schema)
    # a stream reads folders: of a table that is one file, the folder it lies in
    stream = reader.option("pathGlobFilter", "documents.parquet").parquet(sf) if os.path.isfile(f"{sf}/documents.parquet") else reader.parquet(f"{sf}/documents.parquet")
    docs = stream.where("doc_id is not null").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    index_stream(docs, f"{path}/entries", f"{path}/offsets").awaitTermination()
    return indexed_entries(spark, f"{path}/entries").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hashes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _lines(p, **o) for name, (p, _, o, _) in _LINE_SEARCHES.items()}
QUERIES |= {name: _indexed(p, **o) for name, (p, _, o, _) in _INDEXED.items()}
QUERIES |= {
    "files_with_matches": _files("graphite"),
    "count_per_file": _counts("graphite"),
    "file_filter_lines": _lines("graphite", path_filter="^gazette.*/en/"),
    "file_filter_files": _files("graphite", path_filter="archive/(de|fr)/"),
}
QUERIES |= {
    f.__name__: f
    for f in (
        indexed_files_ignore_case, indexed_counts, indexed_file_filter, search_full_scan, search_exists, search_sorted, search_formatted, candidates_missed, trigram_counts, trigram_windows, trigram_document_windows, trigram_loc_mask, trigram_next_mask, trigram_next_char, trigram_hashes, trigram_adjacency, trigram_postings,
        posting_df, posting_intersect, posting_union, posting_subtract, posting_intersect_many, posting_union_many, posting_delta_encode, posting_delta_decode, posting_varint,
        ngram_sparse, ngram_positions, index_entry_counts, ngram_documents, index_stats, index_stats_documents, index_lookup, index_commit, scan_roots, overlay_git, overlay_detect, overlay_search, overlay_refresh, overlay_segments, overlay_compact, filter_binary, filter_size, filter_hidden, corpus_todo_lines, stream_index,
    )
}

_BYTES = "b as (select doc_id, hex(encode(text)) as h, octet_length(encode(text)) as n from documents where text is not null)"
_GRAMS = f"{_BYTES}, g as (select doc_id, i, substr(h, 2 * i + 1, 6) as trigram from (select doc_id, h, unnest(range(n - 2)) as i from b where n >= 3))"
_MASKS = f"{_GRAMS}, m as (select doc_id, trigram, bit_or((1 << (i % 8))::integer) as loc from g group by 1, 2)"
#: The table of the usual 32-bit cyclic redundancy check, made by its rule, and its use on hexadecimal text.
_CRC = """t(i, k, c) as (select range, 0, range from range(256) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from t where k < 8),
crc as (select list(c order by i) as t from t where k = 8)"""
_STEP = "xor(crc.t[1 + (xor(s, x) & 255)], s >> 8)"


def _crc_of(gram: str) -> str:
    digits = f"list_transform(range(0, len({gram}) // 2), lambda k: ('0x' || substr({gram}, 2 * k + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda s, x: {_STEP}), 4294967295)"


_NEXT = f"{_GRAMS}, q as (select g.doc_id, g.trigram, case when g.i + 4 <= b.n then substr(b.h, 2 * g.i + 7, 2) end as follows from g join b on g.doc_id = b.doc_id), f as (select follows, (1 << ({_crc_of('follows')} & 7)::integer) as bit from (select distinct follows from q where follows is not null), crc), m as (select doc_id, trigram, coalesce(bit_or(bit::integer), 0) as next from q left join f on q.follows = f.follows group by 1, 2)"


def _bytes(value: str) -> str:
    """How many bytes of seven bits a number takes."""
    return "1" + "".join(f" + ({value} >= {1 << 7 * k})::bigint" for k in range(1, 10))


_POSTING = "e as (select distinct ngram_hash, doc_id from ngram_entry where ngram_hash is not null and doc_id is not null)"


def _ngram_sql(final: str, of: str = "eval_item", key: str = "item_id") -> str:
    """The closed form of sparse n-grams over the texts' bytes, with the ranks inlined."""
    ranks = ", ".join(str(int(r)) for r in RANKS)
    inner = ", ".join(f"max(w) over (partition by item_id order by i rows between 1 following and {k - 1} following) as m{k}, lead(w, {k}) over (partition by item_id order by i) as w{k}" for k in range(2, 15))
    spans = " union all ".join([f"select item_id, i, 3 as len from x where w1 is not null", *(f"select item_id, i, {k + 2} from x where w{k} is not null and m{k} < least(w, w{k})" for k in range(2, 15))])
    fold = "regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'K', 'k', 'g'), 'ſ', 's', 'g')"
    return f"""
        with recursive {_CRC}, r as (select [{ranks}] as t),
        b as (select {key} as item_id, hex(encode({fold})) as h, octet_length(encode({fold})) as n from {of} where text is not null and {key} is not null),
        c as (select item_id, h, n, unnest(range(n)) as i from b),
        v as (select item_id, h, i, t[1 + ('0x' || substr(h, 2 * i + 1, 2))::integer] as rank from c, r),
        p as (select item_id, h, i, rank * 256 + lead(rank) over (partition by item_id order by i) as w from v),
        x as (select item_id, h, i, w, lead(w, 1) over (partition by item_id order by i) as w1, {inner} from (select * from p where w is not null)),
        s as ({spans}),
        q as (select s.item_id, s.i, s.len, substr(b.h, 2 * s.i + 1, 2 * s.len) as gram from s join b using (item_id))
        {final}"""


def _document_ngram_sql(final: str) -> str:
    return _ngram_sql(final, "documents", "doc_id")


#: Each n-gram of each document once, with its hash.
_HASHED = f", y as (select distinct item_id, gram from q), w as (select gram, {_crc_of('gram')} as hash from (select distinct gram from y), crc), z as (select distinct item_id as doc_id, hash from y join w using (gram))"


_AFTER = """
a as (select doc_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), doc_id::varchar) as path, coalesce(text, '') as text from documents),
z as (select path, case when doc_id % 10 = 7 then text || chr(10) || 'graphite changed' else text end as text from a where doc_id % 10 <> 3
      union all select path || '.new', text from a where doc_id % 10 = 5)
"""

SQL: dict[str, str] = {name: _sql_lines(_re(p, o)) for name, (_, p, _, o) in _LINE_SEARCHES.items()}
SQL |= {name: _sql_lines(_re(p, o)) for name, (_, p, _, o) in _INDEXED.items()}
SQL |= {
    "indexed_files_ignore_case": _sql_lines(_re("piezoelectric lever", "i"), "distinct doc_id, path"),
    "indexed_counts": _sql_lines(_re("ultrasonic (latch|lens)"), "path, count(*) as n", "group by 1"),
    "indexed_file_filter": _sql_lines(_re("piezoelectric (valve|lever|film)") + " and regexp_matches(path, '^[a-m].*/en/')", "path, line"),
    "files_with_matches": _sql_lines(_re("graphite"), "distinct doc_id, path"),
    "count_per_file": _sql_lines(_re("graphite"), "path, count(*) as n", "group by 1"),
    "file_filter_lines": _sql_lines(_re("graphite") + " and regexp_matches(path, '^gazette.*/en/')"),
    "file_filter_files": _sql_lines(_re("graphite") + " and regexp_matches(path, 'archive/(de|fr)/')", "distinct doc_id, path"),
    "search_full_scan": _sql_lines(_re("the.*ing (s|c)")),
    "search_exists": f"with {_DOCS} select 'graphite' as pattern, coalesce(bool_or({_re('graphite')}), false) as found from l union all select 'nonexistent_string_xyz_123', coalesce(bool_or({_re('nonexistent_string_xyz_123')}), false) from l",
    "search_sorted": f"with {_DOCS}, f as (select distinct path, string_split(path, '/') as p from l where {_re('graphite')}) select path, row_number() over (order by p) as place from f",
    "search_formatted": _sql_lines(_re("graphite"), "path || ':' || line_number || ':' || line as result"),
    "candidates_missed": f"with {_DOCS} " + " union all ".join(f"select '{_quoted(p)}' as pattern, count(distinct doc_id) as n_matching, 0::bigint as n_missed, true as is_selective from l where {_re(r, o)}" for p, r, _, o in _INDEXED.values()),
    "trigram_counts": f"with {_GRAMS} select trigram, count(*) as n_occurrences, count(distinct doc_id) as n_docs from g group by 1",
    "trigram_windows": "with b as (select item_id, hex(encode(text)) as h, octet_length(encode(text)) as n from eval_item where text is not null) select item_id, greatest(n - 2, 0)::bigint as n, case when n >= 3 then substr(h, 1, 6) end as first, case when n >= 3 then substr(h, 2 * n - 5, 6) end as last from b",
    "trigram_document_windows": "with b as (select doc_id, hex(encode(text)) as h, octet_length(encode(text)) as n from documents where text is not null) select doc_id, greatest(n - 2, 0)::bigint as n, case when n >= 3 then substr(h, 1, 6) end as first, case when n >= 3 then substr(h, 2 * n - 5, 6) end as last from b",
    "trigram_loc_mask": f"with {_MASKS} select doc_id, count(*) as n_trigrams, sum(loc)::bigint as sum_loc from m group by 1",
    "trigram_next_mask": f"with recursive {_CRC}, {_NEXT} select doc_id, sum(next)::bigint as sum_next, max(next) as max_next from m group by 1",
    "trigram_next_char": f"with recursive {_CRC}, {_NEXT}, z as (select (1 << ({_crc_of("'20'")} & 7)::integer)::integer as bit from crc) select doc_id, count(*) as n_trigrams, sum((next & z.bit <> 0)::bigint)::bigint as n_before_space from m, z group by 1",
    "trigram_hashes": f"with recursive {_CRC}, {_GRAMS} select trigram, {_crc_of('trigram')}::bigint as hash from (select distinct trigram from g), crc",
    "trigram_adjacency": f"with {_MASKS} select a.doc_id, count(*) as n_pairs, sum((((((a.loc << 1) | (a.loc >> 7)) & 255) & b.loc) <> 0)::bigint)::bigint as n_adjacent from m a join m b on a.doc_id = b.doc_id and substr(a.trigram, 3, 4) = substr(b.trigram, 1, 4) group by 1",
    "trigram_postings": f"with {_GRAMS}, k as (select distinct trigram, doc_id from g) select trigram, doc_id // 65536 as chunk, count(*) as n_docs, string_agg(doc_id::varchar, ',' order by doc_id) as doc_ids from k group by 1, 2",
    "posting_df": f"with {_POSTING} select ngram_hash, count(*) as df from e group by 1",
    "posting_intersect": f"with {_POSTING} select doc_id from e where ngram_hash = {_A} intersect select doc_id from e where ngram_hash = {_B}",
    "posting_union": f"with {_POSTING} select doc_id from e where ngram_hash = {_A} union select doc_id from e where ngram_hash = {_B}",
    "posting_subtract": f"with {_POSTING} select doc_id from e where ngram_hash = {_A} except select doc_id from e where ngram_hash = {_B}",
    "posting_intersect_many": f"with {_POSTING} select doc_id from e where ngram_hash in ({_A}, {_B}, {_C}) group by 1 having count(*) = 3",
    "posting_union_many": f"with {_POSTING} select distinct doc_id from e where ngram_hash in ({_A}, {_B}, {_C})",
    "posting_delta_encode": f"with {_POSTING} select ngram_hash, doc_id, doc_id - lag(doc_id, 1, 0) over (partition by ngram_hash order by doc_id) as delta from e",
    "posting_delta_decode": f"with {_POSTING} select ngram_hash, doc_id from e",
    "posting_varint": f"with {_POSTING}, d as (select ngram_hash, doc_id, doc_id - lag(doc_id, 1, 0) over (partition by ngram_hash order by doc_id) as delta from e) select ngram_hash, count(*) as n_docs, (sum({_bytes('delta')}) + {_bytes('count(*)')})::bigint as n_bytes, sum(doc_id)::bigint as sum_ids, max(doc_id) as last_id from d group by 1",
    "ngram_sparse": _ngram_sql("select item_id, count(*) as n_entries, sum(i)::bigint as sum_pos from q group by 1"),
    "index_stats": _ngram_sql("select (select count(distinct item_id) from eval_item) as file_count, count(distinct gram) as ngram_count, count(distinct (gram, item_id)) as posting_count from q"),
    "ngram_positions": _document_ngram_sql("select item_id as doc_id, count(*) as n_entries, sum(i)::bigint as sum_pos from q group by 1"),
    "index_entry_counts": _document_ngram_sql("select d.doc_id, count(q.item_id) as n_entries from documents d left join q on d.doc_id = q.item_id group by 1"),
    "ngram_documents": _document_ngram_sql(_HASHED + " select doc_id, count(*) as n_hashes, min(hash) as least, max(hash) as greatest from z group by 1"),
    "index_stats_documents": _document_ngram_sql(_HASHED + " select (select count(distinct doc_id) from documents) as file_count, count(distinct hash) as ngram_count, count(*) as posting_count from z"),
    "stream_index": _document_ngram_sql(_HASHED + " select doc_id, count(*) as n_hashes from z group by 1"),
    "index_lookup": "select doc_id from documents where contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the')",
    "overlay_detect": f"with {_AFTER} select coalesce(a.path, z.path) as path, case when a.path is null then 'new' when z.path is null then 'deleted' else 'modified' end as status from a full join z on a.path = z.path where a.path is null or z.path is null or a.text <> z.text",
    "overlay_search": rf"with {_AFTER}, u as (select path, unnest(s) as line, generate_subscripts(s, 1)::bigint as line_number from (select path, string_split_regex(text, '\r?\n') as s from z)) select path, line_number, line from u where contains(line, 'graphite')",
    "overlay_refresh": f"with {_AFTER} select path from z where contains(text, 'graphite')",
    "overlay_segments": f"with {_AFTER} select path from z where contains(text, 'graphite')",
    "overlay_compact": f"with {_AFTER} select path from z where contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the')",
    "index_commit": "select trim(commit_sha) as commit_sha from index_meta where trim(coalesce(commit_sha, '')) <> '' and finished_at is not null order by started_at desc, root_id, run_id limit 1",
    "scan_roots": "select row_number() over (order by suite, item_id % 2 = 0, item_id) - 1 as doc_id, suite, case when item_id % 2 = 1 then '_of/' else 'of/' end || lpad(item_id::varchar, 8, '0') || '.txt' as path, octet_length(encode(text))::bigint as size from (select distinct coalesce(suite, 'none') as suite, item_id, coalesce(text, '') as text from eval_item where item_id is not null)",
    "overlay_git": """
        with f as (select distinct item_id % 10 as k, coalesce(suite, 'none') || case when item_id % 2 = 1 then '/_of/' else '/of/' end || lpad(item_id::varchar, 8, '0') || '.txt' as path from eval_item where item_id is not null)
        select path, 'modified' as status from f where k in (2, 3, 4, 5) union all select path, 'deleted' from f where k in (6, 8)
        union all select path || '.new', case when k = 7 then 'modified' else 'new' end from f where k in (7, 9)""",
    "filter_binary": "select distinct doc_id, path from corpus_file where content is null or not regexp_matches(substr(hex(content), 1, 32768), '^(..)*00')",
    "filter_size": "select distinct doc_id, size_bytes from corpus_file where size_bytes is null or size_bytes <= 2500",
    "filter_hidden": "select distinct doc_id, path from corpus_file where not regexp_matches(path, '(^|/)\\.[^/]')",
}
