"""Findings of documents that arrive in a folder, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import session
from ..plans.engine import analyze
from ..sources.scans import _metadata_path


def arriving_documents(path: str) -> DataFrame:
    """Text files of a folder as a stream, each one document."""
    files = session().readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.txt").load(path)
    at = _metadata_path()
    return files.select(F.element_at(F.split(at, "/"), -1).alias("document_name"), at.alias("source_path"), F.col("value").alias("extracted_text"))


def watch_folder(path: str, output: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Analyzes the files that are new since the last run, appends their findings to Parquet files, and ends."""
    findings = analyze(arriving_documents(path), **options).findings
    return findings.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
