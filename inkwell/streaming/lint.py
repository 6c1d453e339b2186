"""Linting of documents that arrive in a folder.

A document never spans two batches and all state is a document's own, so a stream needs no
watermark: each micro-batch is linted as a batch is, with the same code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.lint import lint
from inkwell.plans.config import Config
from inkwell.plans.rules import Rule


def lint_stream(spark: SparkSession, folder: str, schema: str, rules: list[Rule], cfg: Config | None, sink: Callable[[DataFrame, int], None], checkpoint: str, **columns: str) -> StreamingQuery:
    """Lints parquet documents as they land in ``folder``; ``sink(alerts, batch_id)`` should be idempotent by batch."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return (
        docs.writeStream.foreachBatch(lambda batch, i: sink(lint(batch, rules, cfg, **columns), i))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def alerts_stream(docs: DataFrame, rules: list[Rule], cfg: Config | None = None, **columns: str) -> DataFrame:
    """A streaming frame of documents as a streaming frame of alerts; linting is a stateless map."""
    return lint(docs, rules, cfg, **columns)
