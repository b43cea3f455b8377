"""Helpers that keep plans safe when the data is large or lopsided."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
HOT_KEY_ROWS = 1_000_000

_FOLDER: ContextVar[str | None] = ContextVar("corpusmill_folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def new_folder(spark: SparkSession) -> str:
    """A name for a folder of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


@contextmanager
def tables_in(folder: str | None) -> Iterator[None]:
    """Inside, :func:`stored` writes to ``folder``, so that :func:`remove` can clear it all."""
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of :func:`new_folder` with all it holds, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Used where several later steps need the same small table: the work above is
    done once, survives lost executors, and the planner knows the size.
    """
    folder = _FOLDER.get() or shared_dir(df.sparkSession)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Rough size of a frame's values, by one aggregation on the executors."""
    widths = [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns]
    total = sum(widths[1:], widths[0])
    return int(df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0])


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> tuple[DataFrame, bool]:
    """Store a lookup side and mark it for broadcast if it is small.

    Returns the frame and whether it is small.  Beyond the limit the caller's
    join shuffles as usual.
    """
    df = stored(df)
    small = measured_bytes(df) <= limit
    return (F.broadcast(df) if small else df), small


def spread_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: str,
    weight: str,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Left join to a side that is unique on ``keys``, safe for hot keys.

    ``right[weight]`` tells how many left rows a key has.  Keys above
    ``hot_rows`` are cut into slots of about that many rows: right rows are
    copied per slot and left rows are dealt out by a hash of ``spread_by``.
    There are at most (left rows / hot_rows) such keys, which bounds what is
    broadcast; all other keys keep a single slot and cost nothing extra.
    """
    slots = F.ceil(F.col(weight) / F.lit(hot_rows)).cast("int")
    hot = right.where(F.col(weight) > hot_rows).select(*keys, slots.alias("_slots"))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_slot",
        F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_slots")), F.lit(0)).cast("int"),
    )
    copied = right.withColumn(
        "_slot", F.explode(F.sequence(F.lit(0), F.greatest(slots, F.lit(1)) - 1))
    )
    return (
        dealt.drop("_slots")
        .join(copied.drop(weight), [*keys, "_slot"], "left")
        .drop("_slot")
    )


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], within: tuple[str, ...] = ()) -> DataFrame:
    """Add to every row the sums of columns over the rows before it.

    ``sums`` names each new column's summand.  Rows are range-partitioned in
    order and written down, so that the number of a range is the same wherever
    it is read; totals of the ranges are summed first, and a window runs inside
    each range.  So a group of ``within`` (never null) may have any size; only
    one row per range and group meets in a task.
    """
    ranged = stored(df.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*within, "_range").agg(
        *[F.sum(old).alias(f"_total_{new}") for new, old in sums.items()]
    )
    def before(window, column: str):
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    earlier = Window.partitionBy(*within).orderBy("_range")
    inside = Window.partitionBy(*within, "_range").orderBy(*order)
    heads = totals.select(
        *within, "_range", *[before(earlier, f"_total_{new}").alias(f"_before_{new}") for new in sums]
    )
    return (
        ranged.withColumns({f"_inside_{new}": before(inside, old) for new, old in sums.items()})
        .join(heads, [*within, "_range"])
        .select(*df.columns, *[(F.col(f"_before_{new}") + F.col(f"_inside_{new}")).alias(new) for new in sums])
    )
