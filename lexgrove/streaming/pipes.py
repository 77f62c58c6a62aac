"""Documents as a stream: what looks at one document at a time runs in the stream itself, all else in foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokenize
from ..operators.matcher import match
from ..operators.rules import RuleSet


def read_documents(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of documents as they arrive; the schema is the one of those that are there."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def match_stream(docs: DataFrame, rules: RuleSet, key: str = "doc_id") -> DataFrame:
    """Matches of a stream of documents with text; no state is kept."""
    return match(tokenize(docs), rules, key)


def write_matches(matches: DataFrame, folder: str, checkpoint: str, **options: str) -> StreamingQuery:
    return matches.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder, **options)


def run_batches(docs: DataFrame, transform: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Any pipe over micro-batches; a batch that is tried again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
