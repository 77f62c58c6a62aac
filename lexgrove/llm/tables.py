"""Reading tables, choosing bounded training samples and cutting lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An adaptive plan doesn't tell how its result is partitioned.
_FREE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.enabled": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; a small one, of fewer tasks than there are cores, is spread (in an order that doesn't change from one reading to the next)."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id").sortWithinPartitions("doc_id", "text") if docs.rdd.getNumPartitions() < cores else docs


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is named, one of our own, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return tempfile.mkdtemp(prefix="lexgrove-")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in that folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark))
    return df.checkpoint()


def cut_and_free(spark: SparkSession, plan: Callable[[], DataFrame]) -> DataFrame:
    """A checkpoint of what ``plan`` makes, which stays partitioned as it was made, and whose exchanges leave no shuffle files behind. It shares no exchange with another plan."""
    before = {k: spark.conf.get(k) for k in _FREE}
    try:
        for k, v in _FREE.items():
            spark.conf.set(k, v)
        return cut(plan())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def uncut(df: DataFrame) -> None:
    """Removes the files of a checkpoint that nothing reads any more."""
    remove(df.sparkSession, df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """At most ``most`` labelled documents, the ones whose ids hash lowest: the bounded sample that classifiers are fitted on.

    Columns: those of ``docs`` and ``_target``. Rows with a null id or label aren't used; of repeated labels of an id one is."""
    chosen = (
        labels.select(F.col("doc_id").alias("_label_id"), F.col(target).cast("int").alias("_target"))
        .where("_label_id is not null and _target is not null")
        .groupBy("_label_id").agg(F.max("_target").alias("_target"))
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(most)
    )
    # The parameter bounds this side, so it is small whatever the input.
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_label_id"]).drop("_label_id")
