"""Continuous ingest: each new file is transformed once, as it arrives.

The column functions are the same as in batch; the checkpoint remembers which
files were taken, so a rerun handles new files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import transform_column
from ..functions.tokens import heuristic_tokens
from ..operators import filtering
from ..options import JobOptions
from ..sources.corpus import BINARY_SCHEMA, from_binary


def stream_directory(
    spark: SparkSession, root: str, project: str | None = None, bytes_per_batch: int = 64 << 30
) -> DataFrame:
    """Files that appear below ``root``, as a streaming files table.

    A backlog is taken in batches of about ``bytes_per_batch``.  The source takes
    a path once; ``streaming.changes`` takes files again when they change.
    """
    binary = (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true").option("maxBytesPerTrigger", bytes_per_batch).load(root)
    )
    return from_binary(binary, root, project)


def transform_stream(files: DataFrame, options: JobOptions, carry: tuple[str, ...] = ()) -> DataFrame:
    """Scan and transform a streaming (or batch) files table, row by row.

    Ignore files are files of the stream themselves and may come after those
    they rule, so options that ask for them are refused.  ``carry`` names more
    columns to keep.
    """
    if options.respect_gitignore:
        raise ValueError("a stream cannot honour ignore files: set respect_gitignore=False")
    options = filtering.checked_options(files.sparkSession, options)
    taken = filtering.scan(files, options).where("status = 'process' and target <> 'skip'")
    return transform_column(taken, options).withColumn(
        "n_tokens", heuristic_tokens(F.col("content"))
    ).select("project", "rel_path", "target", "content", "n_tokens", *carry)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything new to a Parquet table, then stop."""
    return (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
