"""Reading and writing: graphs, patterns, texts, JSON, and checkpoints."""

from __future__ import annotations

import json
import tempfile
from dataclasses import fields
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..operators.graph import PageGraph


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


def spread(df: DataFrame, by: str) -> DataFrame:
    """df over all cores where its files make few tasks: a small table, or one of few row groups. A large table isn't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, by) if df.rdd.getNumPartitions() < 4 * cores else df


def save_graph(graph: PageGraph, folder: str, meta: dict[str, Any] | None = None) -> None:
    """One Parquet table for each part, and meta as JSON."""
    spark = graph.pages.sparkSession
    for f in fields(graph):
        getattr(graph, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")
    save_meta(spark, folder, meta or {})


def save_meta(spark: SparkSession, folder: str, meta: dict[str, Any]) -> None:
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def load_graph(spark: SparkSession, folder: str) -> PageGraph:
    from ..operators.graph import PageGraph

    return PageGraph(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(PageGraph)})


def load_meta(spark: SparkSession, folder: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{folder}/meta").first().value)


def make_meta(wiki: str, version: str, graph: PageGraph, **more: Any) -> dict[str, Any]:
    """Name, version and sizes of a graph."""
    return {"name": f"{wiki}_{version}", "wiki": wiki, "version": version, **{f"n_{f.name}": getattr(graph, f.name).count() for f in fields(graph)}, **more}


def read_patterns(spark: SparkSession, path: str, key: str = "rule"):  # noqa: ANN201
    """Rules from a file of JSON lines: each a pattern, or an object with one under "pattern". Rules live on the driver, as they are code."""
    from ..operators.rules import rules_of

    return rules_of((r.value for r in spark.read.text(path).toLocalIterator() if r.value.strip()), key)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file, whole; gzip by its ending."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def is_gzip(spark: SparkSession, path: str) -> DataFrame:
    """(path, gzip): whether files begin as gzip does."""
    return spark.read.format("binaryFile").load(path).select("path", (F.substring("content", 1, 2) == F.lit(b"\x1f\x8b")).alias("gzip"))


def write_json(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").json(path, compression="gzip" if compress else "none")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
