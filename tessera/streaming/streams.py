"""Streaming forms: a scan as a stream of new files, and a redaction or any transformation written as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import compile_where
from ..operators.redact import Redaction
from ..schema import Schema


def scan_stream(spark: SparkSession, folder: str, schema: Schema, columns: list[str] | None = None, where: dict | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Rows of files as they arrive in a folder, filtered and projected like a scan."""
    df = spark.readStream.schema(schema.to_spark()).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    condition = compile_where(where, schema)
    if condition is not None:
        df = df.filter(condition)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def redact_stream(df: DataFrame, redaction: Redaction, schema: Schema | None = None) -> DataFrame:
    """A redaction of a stream: it is row by row, so it needs no state."""
    return redaction.apply(df, schema)


def write_stream(df: DataFrame, folder: str, checkpoint: str, once: bool = True, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends a stream to a folder exactly once; with once, it takes what is there and ends."""
    w = df.writeStream.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w
    return w.foreachBatch(each).start() if each else w.format("parquet").option("path", folder).start()
