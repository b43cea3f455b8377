"""Work on texts that many files share, done once for each text.

Files are matched by the SHA-256 of their text (and by what else the work
depends on, such as the extension).  A text that only one file has is worked on
where it is; of a text that several have, the first file's is, and the result
goes to the others by digest.  So an empty ``__init__`` file or a licence that a
million projects hold costs one transformation, and no raw text of copies moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import BROADCAST_LIMIT_BYTES, HOT_KEY_ROWS, small_side, spread_lookup, stored

KEY = ["project", "rel_path"]


def with_copies(
    files: DataFrame, by: tuple[str, ...] = ("ext",), limit: int = BROADCAST_LIMIT_BYTES, hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Add ``_digest``, ``_copies`` and ``_first``.

    ``_copies`` is how many files share the text (1 for a text of its own and
    for null texts), ``_first`` whether this is the first of them by key.
    Digests alone are counted, partially in each task.
    """
    same = ["_digest", *by]
    marked = files.withColumn("_digest", F.sha2("content", 256))
    groups = marked.where("_digest is not null").groupBy(*same).agg(
        F.count("*").alias("_n"), F.min(F.struct(*KEY)).alias("_least")
    )
    groups, small = small_side(groups.where("_n > 1").withColumn("_copies", F.col("_n")), limit)
    if small:
        found = marked.join(groups.drop("_n"), same, "left")
    else:
        found = spread_lookup(marked, groups, same, "rel_path", "_n", hot_rows)
    return (
        found.withColumn("_first", F.coalesce(F.struct(*KEY) == F.col("_least"), F.lit(True)))
        .withColumn("_copies", F.coalesce("_copies", F.lit(1)))
        .drop("_least")
    )


def transform_once(
    files: DataFrame,
    change: Callable[[DataFrame], DataFrame],
    by: tuple[str, ...] = ("ext",),
    made: tuple[str, ...] = ("content",),
    limit: int = BROADCAST_LIMIT_BYTES,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """``change(files)``, where equal texts are worked on once.

    ``change`` works on ``content`` row by row and may look at the ``by``
    columns; ``made`` names the columns that it writes or adds.  ``(project,
    rel_path)`` is the key of ``files``.  Null texts are worked on each.  The
    results of shared texts are stored, so jobs run while the plan is built;
    digests that more than ``hot_rows`` files share are joined back in slots.
    """
    same = ["_digest", *by]
    flagged = with_copies(files, by, limit, hot_rows)
    kept = [c for c in files.columns if c not in made]
    own = flagged.where("_copies = 1").select(*files.columns)
    firsts = flagged.where("_copies > 1 and _first").select(*files.columns, "_digest", "_copies")
    results = stored(change(firsts).select(*same, "_copies", *made))
    members = flagged.where("_copies > 1").select(*kept, "_digest")
    joined = spread_lookup(members, results, same, "rel_path", "_copies", hot_rows)
    return change(own).select(*kept, *made).unionByName(joined.select(*kept, *made))
