"""Session helpers shared by all operators: the shared scratch folder and plan inspection."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (local tests) a
    temporary folder is made, set for the session and removed at exit.
    """
    root = spark.conf.get(_CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quernel-")
        atexit.register(shutil.rmtree, path, True)
        root = "file://" + path
        spark.conf.set(_CHECKPOINT_CONF, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/quernel/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage without depending on any one executor: the written table survives their
    loss. The files go when the interpreter ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


_STABLE = {"Project", "Filter", "LogicalRelation", "SubqueryAlias", "LogicalRDD"}


def is_plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads files, filters and projects.

    Such a plan gives the same rows in the same order to the same partition each time it runs,
    also when a task is retried, which a plan with a shuffle does not promise.
    """
    def names(node) -> list[str]:
        out = [node.getClass().getSimpleName()]
        children = node.children()
        for i in range(children.size()):
            out += names(children.apply(i))
        return out

    found = names(df._jdf.queryExecution().optimizedPlan())
    return "LogicalRelation" in found and set(found) <= _STABLE


def stable_scan(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it is a plain file scan, else the table it was written to."""
    return df if is_plain_scan(df) else stored(df, name)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df``, shuffled evenly if its files give fewer partitions than there is parallelism.

    For work that costs far more per row than moving the row; large inputs are left as they are.
    """
    n = parallelism(df.sparkSession)
    return df.repartition(n) if is_plain_scan(df) and df.rdd.getNumPartitions() < n else df


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the frame's size; 0 where it has none."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 60 else 0


def numbered(ordered: DataFrame, to: str, name: str) -> DataFrame:
    """``ordered``, a frame sorted as a whole, with dense numbers from 0 in the column ``to``.

    Sorted partitions number their rows; only the partitions' sizes are summed in one place.
    """
    rows = stored(ordered.withColumn("number_in_part", F.monotonically_increasing_id()), name)
    part, within = F.shiftright("number_in_part", 33), F.col("number_in_part").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("part_no")).agg(F.count(F.lit(1)).alias("part_size"))
    before = sizes.select("part_no", (F.sum("part_size").over(W.orderBy("part_no")) - F.col("part_size")).alias("rows_before"))
    dense = rows.withColumn("part_no", part).join(F.broadcast(before), "part_no")  # a row per partition
    return dense.withColumn(to, F.col("rows_before") + within).drop("number_in_part", "part_no", "part_size", "rows_before")
