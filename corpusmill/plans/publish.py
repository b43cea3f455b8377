"""Writing blocks as text files in document order, all outputs of a run at once.

A run writes its documents into a hidden folder beside their places, then a
manifest that names them, and only then moves them there.  The manifest is the
commit: before it nothing has changed for a reader, after it the set is
complete, wherever its parts stand just then.  A run that was stopped in between
is finished by the next one, or read through :func:`located`.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assembly import ORDER

_MANIFEST = ".manifest"


def publish(outputs: dict[str, DataFrame], shared: DataFrame | None, directory: str, prefix: str) -> None:
    """Write one document per output and project, to ``directory/<output>/project=<name>/``.

    ``outputs`` gives each output's own blocks; ``shared`` holds blocks with an
    array ``outputs`` of the names they go to, so that their text is read once.
    Everything goes through one range sort on output and document key, so a very
    large project is written by many tasks.  A document's part files, read in
    name order, are the document.  What stood in these places before goes.
    """
    spark = (shared if shared is not None else next(iter(outputs.values()))).sparkSession
    names = list(outputs)
    number = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))])
    columns = ["output", *ORDER, "value"]
    parts = [blocks.withColumn("output", F.lit(names.index(name))).select(*columns) for name, blocks in outputs.items()]
    if shared is not None:
        each = shared.withColumn("output", F.explode("outputs"))
        parts.append(each.withColumn("output", F.try_element_at(number, "output")).select(*columns))
    blocks = reduce(DataFrame.unionByName, parts)
    # A partition column that may be null makes the writer sort once more, on
    # the partition alone, which would undo the order within it.
    blocks = blocks.withColumns({
        "project": F.coalesce("project", F.lit("")), "output": F.coalesce("output", F.lit(-1)),
    })
    staged = f".{prefix}-{uuid.uuid4().hex}"
    (
        blocks.orderBy("output", *ORDER)
        .select("output", "project", "value")
        .write.partitionBy("output", "project")
        .text(f"{directory}/{staged}")
    )
    commit(spark, directory, staged, names)
    finish(spark, directory, prefix)


def commit(spark: SparkSession, directory: str, staged: str, names: list[str]) -> None:
    """Write the manifest of a staged set, in one step."""
    fs, path = _filesystem(spark, directory)
    for i in range(len(names)):
        # An output without a single block is an empty folder.
        fs.mkdirs(path(f"{staged}/output={i}"))
    draft = path(f"{staged}/_draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(names).encode()))
    stream.close()
    if not fs.rename(draft, path(staged + _MANIFEST)):
        raise OSError(f"cannot write the manifest of {directory}/{staged}")


def finish(spark: SparkSession, directory: str, prefix: str) -> list[str]:
    """Move all sets that have a manifest to their places; returns the outputs moved.

    Safe to run again after it was stopped anywhere: an output that is still
    staged has not been moved yet.
    """
    fs, path = _filesystem(spark, directory)
    moved = []
    for staged, names in _committed(spark, directory, prefix):
        for i, name in enumerate(names):
            source, target = path(f"{staged}/output={i}"), path(name)
            if not fs.exists(source):
                continue
            fs.delete(target, True)
            if not fs.rename(source, target):
                raise OSError(f"cannot move {source} to {target}")
            moved.append(name)
        # The manifest goes first: a folder without one means nothing to anybody.
        fs.delete(path(staged + _MANIFEST), False)
        fs.delete(path(staged), True)
    return moved


def located(spark: SparkSession, directory: str, prefix: str, names: list[str]) -> dict[str, str]:
    """Where each output of the newest complete set can be read."""
    fs, path = _filesystem(spark, directory)
    found = {name: f"{directory}/{name}" for name in names if fs.exists(path(name))}
    for staged, listed in _committed(spark, directory, prefix):
        for i, name in enumerate(listed):
            if name in names and fs.exists(path(f"{staged}/output={i}")):
                found[name] = f"{directory}/{staged}/output={i}"
    return found


def drop_unfinished(spark: SparkSession, directory: str, prefix: str) -> int:
    """Delete staged folders without a manifest; only while no run is writing there."""
    fs, path = _filesystem(spark, directory)
    kept = {staged for staged, _ in _committed(spark, directory, prefix)}
    gone = [n for n, _ in _listed(fs, path, prefix) if not n.endswith(_MANIFEST) and n not in kept]
    for name in gone:
        fs.delete(path(name), True)
    return len(gone)


def existing_outputs(spark: SparkSession, directory: str, names: list[str]) -> list[str]:
    """Which of the planned outputs are already there."""
    fs, path = _filesystem(spark, directory)
    return [f"{directory}/{name}" for name in names if fs.exists(path(name))]


def _filesystem(spark: SparkSession, directory: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(directory).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, lambda name: hadoop.Path(f"{directory}/{name}")


def _listed(fs, path, prefix: str) -> list[tuple[str, int]]:
    """Hidden names of this prefix with their times."""
    if not fs.exists(path("")):
        return []
    entries = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path(""))]
    hexadecimal = set("0123456789abcdef")
    return [
        (n, t) for n, t in entries
        if n.startswith(f".{prefix}-") and len(rest := n[len(prefix) + 2 :].removesuffix(_MANIFEST)) == 32
        and set(rest) <= hexadecimal
    ]


def _committed(spark: SparkSession, directory: str, prefix: str) -> list[tuple[str, list[str]]]:
    """Staged folders with a manifest and the names in it, oldest first."""
    fs, path = _filesystem(spark, directory)
    found = []
    for name, _ in sorted(_listed(fs, path, prefix), key=lambda entry: (entry[1], entry[0])):
        if name.endswith(_MANIFEST):
            stream = fs.open(path(name))
            try:
                listed = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
            found.append((name.removesuffix(_MANIFEST), listed))
    return found
