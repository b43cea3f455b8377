"""Files that change while a stream takes them.

Spark's file source takes a path once.  Here every run lists the directory and
adds the listing to a folder that *is* streamed, so a path comes again with its
time and size.  A keyed state holds what was taken last of each path; only
states that are newer get through.  Their files are read, transformed and
written under the number of the batch, and :func:`current` reads the newest row
of each path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..options import JobOptions
from ..scale import stored
from ..sources.corpus import BINARY_SCHEMA, from_binary
from .ingest import transform_stream

LISTING = "path string, mtime bigint, length bigint"
_STATE = "mtime bigint, length bigint, version bigint"
_TAKEN = "path string, mtime bigint, length bigint, version bigint"


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest state of one path, if it is newer than the one taken last.

    States are ordered by time and then size, so neither the order in which
    they come nor how they are split into batches changes which one stays.
    """
    mtime, length, version = state.get if state.exists else (None, None, 0)
    best = (mtime, length)
    for batch in batches:
        for seen in zip(batch["mtime"].tolist(), batch["length"].tolist()):
            if best[0] is None or seen > best:
                best = seen
    if best != (mtime, length):
        state.update((*best, version + 1))
        yield pd.DataFrame({"path": [key[0]], "mtime": [best[0]], "length": [best[1]], "version": [version + 1]})


def newer_states(listing: DataFrame) -> DataFrame:
    """``(path, mtime, length, version)`` of paths that a streaming listing shows to be new or changed.

    The state is three numbers a path, kept by Spark's state store by key, so
    it is spread over the executors and survives a restart.
    """
    return listing.groupBy("path").applyInPandasWithState(
        _newest, _TAKEN, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def add_listing(spark: SparkSession, root: str, place: str) -> None:
    """List the files below ``root`` and add their times and sizes to ``place``.

    Nothing is read: Spark prunes the content from the scan.
    """
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    facts = binary.select("path", F.unix_micros("modificationTime").alias("mtime"), "length")
    facts.write.mode("append").parquet(place)


def _texts(spark: SparkSession, root: str, taken: DataFrame, project: str | None) -> DataFrame | None:
    """The files that ``taken`` names, as a files table with ``version``."""
    since = taken.agg(F.min("mtime")).first()[0]
    if since is None:
        return None
    binary = spark.read.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").load(root)
    # The time is compared before a file is opened; older files are never read.
    recent = binary.where(F.col("modificationTime") >= F.timestamp_micros(F.lit(since)))
    wanted = recent.join(taken.select("path", "version"), "path")
    return from_binary(wanted, root, project, carry=("version",))


def ingest_changes(
    spark: SparkSession, root: str, options: JobOptions, path: str, checkpoint: str, project: str | None = None,
) -> None:
    """Take files below ``root`` that are new or have changed since the last call.

    Each batch writes the folder ``path/batch=<number>``.  A batch that is
    repeated after a crash has the same number and replaces what it left.  A
    file that is rewritten between listing and reading is taken as it is then,
    and once more by the next call.
    """
    listings = f"{checkpoint.rstrip('/')}/listings"
    add_listing(spark, root, listings)

    def write(batch: DataFrame, number: int) -> None:
        # Asked twice; stored, so that the state is walked once.
        files = _texts(spark, root, stored(batch), project)
        if files is None:
            return
        done = transform_stream(files, options, carry=("version", "mtime"))
        done.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    stream = newer_states(spark.readStream.schema(LISTING).parquet(listings))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint.rstrip('/')}/offsets").outputMode(
        "append"
    ).trigger(availableNow=True).start().awaitTermination()


def current(versions: DataFrame) -> DataFrame:
    """The newest row of each file; of equal versions the one of the later batch.

    Versions are compared without the text.
    """
    key = ["project", "rel_path"]
    mark = F.struct("version", "batch")
    newest = versions.groupBy(*key).agg(F.max(mark).alias("_newest"))
    return (
        versions.join(newest, key).where(mark == F.col("_newest"))
        .drop("_newest", "version", "batch")
    )
