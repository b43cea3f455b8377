"""Reading a mounted directory tree with hidden names and early pruning.

Folders are listed level by level: each level is a distributed job over the
folders found by the one before, so neither the driver nor a single task ever
walks the whole tree.  Files are then dealt out and read in parallel.
The root must be mounted at the same path on every executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import read_text
from ..options import JobOptions
from ..scale import prefix_sums, stored

READ_TASK_BYTES = 128 * 1024 * 1024
OPEN_BYTES = 64 * 1024
_BATCH_BYTES = 32 * 1024 * 1024
_ENTRY = "rel_path string, is_dir boolean, mtime timestamp, length bigint, error string"
_CHUNK = 10_000
_READ = "rel_path string, raw binary, mtime timestamp, length bigint, error string"


def _entries(root: str, folder: str) -> Iterator[tuple]:
    """Folders and files directly in one folder, one by one.

    A folder that cannot be listed is one entry with the reason; the root must
    be there.
    """
    try:
        with os.scandir(os.path.join(root, folder)) as listing:
            for item in listing:
                path = f"{folder}/{item.name}" if folder else item.name
                if item.is_dir():
                    if not item.is_symlink():
                        yield path, True, None, 0, None
                    continue
                try:
                    state = item.stat()
                    yield path, False, pd.Timestamp(state.st_mtime_ns // 1000, unit="us"), state.st_size, None
                except OSError:
                    yield path, False, None, 0, None
    except OSError as problem:
        if not folder:
            raise
        yield folder, False, None, 0, str(problem)


def list_tree(spark: SparkSession, root: str, exclude_patterns: tuple[str, ...]) -> DataFrame:
    """All files below ``root`` outside excluded folders, without content."""
    patterns = names.valid_patterns(spark, exclude_patterns)

    def one_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["rel_path", "is_dir", "mtime", "length", "error"]
        for batch in batches:
            for folder in batch["rel_path"]:
                entries = _entries(root, folder)
                # A flat folder may hold any number of names.
                while chunk := list(islice(entries, _CHUNK)):
                    yield pd.DataFrame(chunk, columns=columns).astype(
                        {"mtime": "datetime64[us]", "is_dir": "bool", "length": "int64", "error": "object"}
                    )

    level = spark.createDataFrame([("",)], "rel_path string")
    files: DataFrame | None = None
    while True:
        # Written down, so that a lost executor does not restart the walk.
        entries = stored(level.mapInPandas(one_level, _ENTRY))
        here = entries.where("not is_dir").drop("is_dir")
        files = here if files is None else files.unionByName(here)
        folders = entries.where(
            F.col("is_dir") & ~names.hits_any(names.base_name(F.col("rel_path")), patterns)
        ).select("rel_path")
        if folders.isEmpty():
            return files
        level = folders.repartition("rel_path")


def deal_by_size(listed: DataFrame, task_bytes: int = READ_TASK_BYTES, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """The listing in partitions of about equal size, neighbours together.

    A file costs its length and ``open_bytes``.  Cumulative costs in path order
    cut the listing into ranges of ``task_bytes``, or less where the cores would
    not all have work; a file above that is a range of its own.  So no task reads
    more than twice as much, or one file.
    """
    cost = (F.greatest("length", F.lit(0)) + open_bytes).alias("_cost")
    priced = listed.select("*", cost)
    total = priced.agg(F.coalesce(F.sum("_cost"), F.lit(0))).first()[0]
    share = min(task_bytes, max(open_bytes, total // listed.sparkSession.sparkContext.defaultParallelism, 1))
    large = F.col("_cost") >= share
    priced = priced.withColumns({
        "_small_cost": F.when(large, 0).otherwise(F.col("_cost")), "_large": F.when(large, 1).otherwise(0),
    })
    sizes = priced.agg(F.coalesce(F.sum("_small_cost"), F.lit(0)), F.coalesce(F.sum("_large"), F.lit(0))).first()
    n_small = sizes[0] // share + 1
    placed = prefix_sums(priced, ["rel_path"], {"_start": "_small_cost", "_rank": "_large"})
    number = F.when(large, F.col("_rank") + n_small).otherwise(F.floor(F.col("_start") / share))
    return placed.repartitionById(int(n_small + sizes[1]), number.cast("int")).select(*listed.columns)


def read_directory(
    spark: SparkSession, root: str, options: JobOptions, project: str | None = None
) -> DataFrame:
    """Files table of one project directory.

    Each file is read once, into a table in the shared folder: later steps see
    one state of the directory and read only the columns they need.  A file
    that cannot be read keeps its row, with the reason in ``error``, and so does
    a folder that cannot be listed.  A root that does not exist is an error.
    """
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such directory: {root}")
    listed = list_tree(spark, root, options.exclude_patterns)
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for row in batch.itertuples(index=False):
                raw, error = None, row.error
                try:
                    if error is not None:
                        raise OSError(error)
                    with open(os.path.join(root, row.rel_path), "rb") as stream:
                        raw = stream.read()
                except OSError as problem:
                    error = str(problem)
                rows.append((row.rel_path, raw, row.mtime, row.length, error))
                size += row.length
                if size >= _BATCH_BYTES:
                    yield _frame(rows)
                    rows, size = [], 0
            yield _frame(rows)

    found = deal_by_size(listed).mapInPandas(read, _READ)
    name = project or os.path.basename(root.rstrip("/"))
    return stored(found.select(
        F.lit(name).alias("project"), "rel_path", read_text(F.col("raw")).alias("content"),
        "mtime", "length", "error",
    ))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["rel_path", "raw", "mtime", "length", "error"])
    return frame.astype({"mtime": "datetime64[us]", "length": "int64"})
