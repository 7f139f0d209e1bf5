"""Queries of the training-data operators (problems 1, 2 and 5 to 9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import encoding, frequency, handwritten, leakage, mixture, neardup, truncation
from quernel.runtime import table


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, sf, "ngram_entry"), "ngram_hash", "doc_id", "pos")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    freq = _terms(spark, sf)
    return freq.select(F.col("term").alias("ngram_hash"), frequency.mark(freq).alias("mark")).where("mark is not null")


def p1_frequency(spark: SparkSession, sf: str) -> DataFrame:
    freq = _terms(spark, sf)
    return freq.select(F.col("term").alias("ngram_hash"), F.col("occurrences").alias("n_occurrences"), F.col("records").alias("n_files"), frequency.mark(freq).alias("mark"))


def _files(spark: SparkSession, sf: str) -> neardup.NearDuplicates:
    return neardup.near_duplicates(table(spark, sf, "ngram_entry"), "doc_id", "ngram_hash", threshold=0.7, least=30)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).pairs().select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).groups().withColumnRenamed("record", "doc_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = encoding.find_garbled(table(spark, sf, "search_hit"), "hit_id", "line")
    return found.where("key is not null").select(F.col("key").alias("hit_id")).distinct()


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled lines with the encodings they went through and their proper text."""
    hits = table(spark, sf, "search_hit").select("hit_id", "line").distinct()
    return encoding.find_garbled(hits, "hit_id", "line").withColumnRenamed("key", "hit_id")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.find_not_handwritten(table(spark, sf, "corpus_file"), "doc_id", "root_id", "path", "content", "indexed_at")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).where("kind is not null").select(F.col("key").alias("doc_id"))


def p5_by_root(spark: SparkSession, sf: str) -> DataFrame:
    """Files per root and kind; hand-written files have the kind ``handwritten``."""
    return _marked(spark, sf).groupBy(F.col("root").cast("int").alias("root_id"), F.coalesce("kind", F.lit("handwritten")).alias("kind")).agg(F.count(F.lit(1)).alias("n_files"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_item"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with passages of test items, and their text without them."""
    return leakage.remove_leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_item"), "item_id", "text").withColumnRenamed("doc", "doc_id")


def _mixture(spark: SparkSession, sf: str) -> mixture.Mixture:
    return mixture.mix(table(spark, sf, "documents"), "doc_id", "source", "text", table(spark, sf, "mix_target"), "source", "target_share", "max_repeats")


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The drawn documents, one row per use, in global random order."""
    return _mixture(spark, sf).draws().withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and reached share of each source."""
    return _mixture(spark, sf).report


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per wanted source: its documents, whether its repetitions keep the cap, whether the drawn rows have the
    tokens that the report says, and whether the share reached is near the one wanted, by three times what
    chance makes of so many draws."""
    m = _mixture(spark, sf)
    drawn = m.draws().groupBy("source").agg(F.sum("n_tokens").alias("drawn"), F.max("copy").alias("most"))
    n = m.report.agg(F.sum("n_draws").alias("all_draws"))
    r = m.report.join(drawn, "source", "left").join(F.broadcast(n))  # one row
    return r.select(
        "source",
        "n_docs",
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("keeps_cap"),
        (F.coalesce("drawn", F.lit(0)) == F.col("tokens")).alias("agrees"),
        (F.abs(F.col("reached_share") - F.col("target_share")) <= 3 / F.sqrt("all_draws")).alias("is_near"),
    )


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.detect_truncation(table(spark, sf, "documents"), "doc_id", "source", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _ends(spark, sf).where("is_truncated").select(F.col("key").alias("doc_id"))


def p9_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_report(_ends(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_frequency, p2_found, p2_restored, p5_found, p5_by_root, p6_found, p6_groups, p7_found, p7_cleaned, p8_mixture, p8_shares, p8_checks, p9_found, p9_by_source)}

_SETS = """
    e as (select distinct doc_id, ngram_hash from ngram_entry where doc_id is not null and ngram_hash is not null),
    s as (select doc_id, count(*) n, list(ngram_hash order by ngram_hash) as k from e group by 1 having count(*) >= 30),
    b as (select a.doc_id a, b.doc_id b, count(*) shared from (select e.* from e join s using (doc_id)) a join (select e.* from e join s using (doc_id)) b on a.ngram_hash = b.ngram_hash and a.doc_id < b.doc_id group by 1, 2),
    p as (select b.a, b.b from b join s x on x.doc_id = b.a join s y on y.doc_id = b.b where shared >= 0.7 * (x.n + y.n - shared))
"""
_WORDS = "list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: w)"
_WINDOWS = "array_to_string(w[i:i + 11], ' ')"

SQL = {
    "p6_found": f"with {_SETS} select a as doc_id_a, b as doc_id_b from p",
    "p6_groups": f"""
        with recursive {_SETS},
        m as (select doc_id, min(doc_id) over (partition by k) as class_id, count(*) over (partition by k) as n_copies from s),
        l as (select p.a, p.b from p join m x on x.doc_id = p.a and x.class_id = p.a join m y on y.doc_id = p.b and y.class_id = p.b where x.class_id <> y.class_id),
        d as (select a, b from l union all select b, a from l),
        g as (select a as node, a as top from d union select d.b, g.top from g join d on d.a = g.node)
        select m.doc_id, m.class_id, m.n_copies, (select count(*) from d where d.a = m.class_id) as n_links, coalesce((select min(top) from g where g.node = m.class_id), m.class_id) as group_id from m""",
    "p7_found": f"""
        with i as (select item_id, {_WORDS} as w from eval_item where text is not null and item_id is not null),
        j as (select distinct item_id, {_WINDOWS} as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from i where len(w) >= 12)),
        d as (select doc_id, {_WORDS} as w from documents where text is not null),
        k as (select doc_id, {_WINDOWS} as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d where len(w) >= 12))
        select distinct doc_id, item_id from k join j using (g)""",
    "p8_checks": "select t.source, (select count(*) from documents d where d.source = t.source) as n_docs, true as keeps_cap, true as agrees, true as is_near from (select distinct source from mix_target) t",
    "p1_found": """
        with f as (select ngram_hash, count(distinct doc_id) n from ngram_entry where doc_id is not null and ngram_hash is not null group by 1)
        select ngram_hash, case when n = 1 then 'rare' else 'common' end mark from f
        where n = 1 or n > 0.25 * (select count(distinct doc_id) from ngram_entry)""",
    "p1_frequency": """
        with e as (select distinct ngram_hash, doc_id, pos from ngram_entry where doc_id is not null and ngram_hash is not null),
        f as (select ngram_hash, count(*) n_occurrences, count(distinct doc_id) n_files from e group by 1)
        select *, case when n_files = 1 then 'rare' when n_files > 0.25 * (select count(distinct doc_id) from ngram_entry) then 'common' end mark from f""",
}
