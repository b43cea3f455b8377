"""Reading corpora of files: tables, and directories through ``binaryFile``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import read_text

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def from_table(
    table: DataFrame, project: str = "project", rel_path: str = "rel_path",
    content: str = "content", **optional: str,
) -> DataFrame:
    """A files table from any table that has a project, a path and a text.

    ``optional`` names the columns that hold ``mtime`` and ``length``.
    """
    kind = table.schema[content].dataType.simpleString()
    text = read_text(F.col(content)) if kind == "binary" else F.regexp_replace(content, r"\r\n?", "\n")
    return table.select(
        F.col(project).alias("project"), F.col(rel_path).alias("rel_path"), text.alias("content"),
        *[F.col(column).alias(name) for name, column in optional.items()],
    )


def from_binary(binary: DataFrame, root: str, project: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """A files table from a ``binaryFile`` frame (batch or streaming).

    Below ``root`` the first folder names the project, unless one is given.
    ``carry`` names more columns to keep.
    """
    if "://" not in root:
        root = os.path.abspath(root)
    inside = F.regexp_replace("path", r"\A[a-z0-9+.-]+:/*(?=/)", "")
    local = "/" + root.split("://", 1)[-1].strip("/") + "/"
    below = F.call_function(
        "substr", inside, F.locate(local, inside) + F.lit(len(local))
    )
    name = F.lit(project) if project else F.substring_index(below, "/", 1)
    path = below if project else F.regexp_replace(below, r"\A[^/]*/", "")
    return binary.select(
        name.alias("project"), path.alias("rel_path"), read_text(F.col("content")).alias("content"),
        F.col("modificationTime").alias("mtime"), "length", *carry,
    )


def read_binary(
    spark: SparkSession, root: str, project: str | None = None, name_glob: str | None = None
) -> DataFrame:
    """Read a directory with Spark's own listing.

    Fast, and works on any Hadoop file system, but Spark's listing leaves out
    names that start with ``_`` or ``.``; ``sources.directory`` keeps them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return from_binary(reader.load(root), root, project)
