"""Queries of the general data operators (problems 3 and 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import incremental, skew
from quernel.runtime import scratch_path, table

HOT_SHARE = 0.02


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    return skew.fold_by_key(table(spark, sf, "ngram_entry"), "ngram_hash", "doc_id", "pos")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return skew.hot_keys(_folded(spark, sf), HOT_SHARE).select(F.col("key").alias("ngram_hash"))


def p3_hash_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf).select(
        F.col("key").alias("ngram_hash"),
        "n_rows",
        F.col("n_values").alias("n_filed"),
        F.col("min_measure").alias("min_pos"),
        F.col("max_measure").alias("max_pos"),
        F.col("sum_measure").alias("sum_pos"),
        (F.col("n_rows") > HOT_SHARE * F.col("total_rows")).alias("is_hot"),
    )


def p3_hash_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one file per hash in stored order, and the chunks its rows were cut into."""
    return _folded(spark, sf).select(F.col("key").alias("ngram_hash"), "n_runs", F.col("first_value").alias("first_doc_id"), F.col("last_value").alias("last_doc_id"), "n_chunks")


def _successful():
    return (F.trim(F.coalesce(F.col("commit_sha"), F.lit(""))) != "") & F.col("finished_at").isNotNull()


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "overlay_change").where(F.col("change_id").isNotNull())
    return rows.groupBy("change_id").agg(F.min("recorded_at").alias("recorded_at"), F.min("root_id").alias("root_id"))


def _replayed(spark: SparkSession, sf: str, changes: DataFrame) -> incremental.Target:
    runs = table(spark, sf, "index_meta")
    return incremental.replay(spark, changes, runs, scratch_path(spark, "target"), "change_id", "root_id", "recorded_at", "started_at", _successful())


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The next run: the published target of the runs so far, anti-joined with all changes."""
    changes = _changes(spark, sf)
    target = _replayed(spark, sf, changes)
    _, rows = incremental.run_incremental(changes, target, "change_id", "recorded_at", lambda new: new.select(incremental.KEY, incremental.VERSION))
    return rows.select(F.col(incremental.KEY).alias("change_id"))


def p4_second_run(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the run after the next one on an unchanged source, per root: none may come twice."""
    changes = _changes(spark, sf)
    target = _replayed(spark, sf, changes)
    keep = lambda new: new.select(incremental.KEY, incremental.VERSION, "root_id")
    _, first = incremental.run_incremental(changes, target, "change_id", "recorded_at", keep)
    _, second = incremental.run_incremental(changes, target, "change_id", "recorded_at", keep)
    runs = first.select("root_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.select("root_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return runs.groupBy("root_id").agg(F.sum("a").alias("n_first"), F.sum("b").alias("n_second"))


def p4_after_failure(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs over a growing source: the first publishes, the second fails after it has written
    rows, the third publishes. Every change with the version in which it came, once."""
    changes = _changes(spark, sf)
    early = table(spark, sf, "index_meta").where(_successful()).agg(F.max("started_at").alias("t"))
    seen = changes.join(F.broadcast(early), F.col("recorded_at") <= F.col("t")).drop("t")  # one row
    target = incremental.Target(spark, scratch_path(spark, "target"))
    keep = lambda new: new.select(incremental.KEY, incremental.VERSION)

    def broken(new: DataFrame) -> DataFrame:
        rows = keep(new)
        rows.write.parquet(f"{target.path}/v000000002-left")  # rows of a run that dies before it commits
        raise RuntimeError("a run that fails")

    incremental.run_incremental(seen, target, "change_id", "recorded_at", keep)
    try:
        incremental.run_incremental(changes, target, "change_id", "recorded_at", broken)
    except RuntimeError:
        pass
    incremental.run_incremental(changes, target, "change_id", "recorded_at", keep)
    parts = [spark.read.parquet(f"{target.path}/{folder}").select(F.col(incremental.KEY).alias("change_id"), F.lit(n).cast("long").alias("version")) for n, folder in target.versions()]
    return parts[0].unionByName(parts[1])


_NEW = """
with c as (select change_id, min(recorded_at) recorded_at, min(root_id) root_id from overlay_change where change_id is not null group by 1),
r as (select root_id, max(started_at) started_at from index_meta where trim(coalesce(commit_sha, '')) <> '' and finished_at is not null group by 1)
"""

QUERIES = {"p3_found": p3_found, "p3_hash_profile": p3_hash_profile, "p3_hash_runs": p3_hash_runs, "p4_found": p4_found, "p4_second_run": p4_second_run, "p4_after_failure": p4_after_failure}

SQL = {
    "p3_found": "select ngram_hash from ngram_entry where ngram_hash is not null group by 1 having count(*) > 0.02 * (select count(*) from ngram_entry)",
    "p3_hash_profile": """
        select ngram_hash, count(*) n_rows, count(doc_id) n_filed, min(pos)::bigint min_pos, max(pos)::bigint max_pos, sum(pos)::bigint sum_pos,
               count(*) > 0.02 * (select count(*) from ngram_entry) is_hot
        from ngram_entry group by 1""",
    "p3_hash_runs": """
        with o as (select ngram_hash, doc_id, row_number() over () as rn from ngram_entry),
        r as (select ngram_hash, doc_id, rn, lag(rn) over w is null or doc_id is distinct from lag(doc_id) over w as is_new from o window w as (partition by ngram_hash order by rn))
        select ngram_hash, sum(is_new::bigint)::bigint n_runs, arg_min_null(doc_id, rn) first_doc_id, arg_max_null(doc_id, rn) last_doc_id,
               ceil(count(*) / greatest(8192, ceil((select count(*) from ngram_entry) / 4096)))::bigint n_chunks
        from r group by 1""",
    "p4_found": _NEW + "select change_id from c left join r using (root_id) where r.started_at is null or c.recorded_at is null or c.recorded_at > r.started_at",
    "p4_after_failure": _NEW + "select change_id, case when recorded_at <= (select max(started_at) from r) then 1 else 2 end::bigint as version from c",
    "p4_second_run": _NEW + "select c.root_id root_id, count(*)::bigint n_first, 0::bigint n_second from c left join r using (root_id) where r.started_at is null or c.recorded_at is null or c.recorded_at > r.started_at group by 1",
}
