"""Linting of files as they arrive. Findings depend on single documents only, so the stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lint import lint


def stream_documents(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(path, text) of the files that appear in a folder."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def stream_findings(docs: DataFrame, out: str, checkpoint: str, config: dict | None = None, available_now: bool = True) -> StreamingQuery:
    """Appends the findings of each batch to Parquet; collapsing, which needs a document's rows together, runs within the batch."""

    def write(batch: DataFrame, number: int) -> None:
        lint(batch, config).write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same batch again replaces itself

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
