"""The text steps on very long texts, cut at line ends so that many tasks share one.

Redaction, masking and minifying keep line semantics, so a text may be cut after
any line feed.  What a segment cannot see of its neighbour is little: only a run
of blank lines may lie across the seam.  Within segments such runs are collapsed
already, so one look at the end of the segment before tells whether the blank
line at a segment's start has to go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as steps
from ..functions.pycode import is_python
from ..options import JobOptions
from ..scale import spread_lookup, stored

SEGMENT_BYTES = 8 * 1024 * 1024
# Rows that hold one and the same long text and are put together by one task.
COPIES_PER_TASK = 64
# Sizes below which line feeds are looked up, instead of trying every ``size`` bytes, and in blocks of how many bytes.
FEW_BYTES, BLOCK_BYTES = 64, 512


def line_segments(text: Column, size: int = SEGMENT_BYTES) -> Column:
    """A text cut after the first line feed beyond every ``size`` bytes, as an array.

    Joined, the segments are the text; all end with a line feed but the last,
    and none is empty unless the text is.  A line is never cut, so a segment is
    shorter than twice ``size`` unless a longer line is in it.
    """
    def cut(whole: Column) -> Column:
        length = F.octet_length(whole)

        def break_in(i: Column) -> Column:
            # Counted in bytes: no other character's UTF-8 holds the byte of a line feed.
            piece = F.substring(whole, i * size + 1, F.lit(size)).cast("string")
            ahead = F.octet_length(F.substring_index(piece, "\n", 1))
            return F.when(ahead < F.octet_length(piece), i * size + ahead + 1)

        def breaks_of(block: Column) -> Column:
            # One character a byte, so that the lengths of lines are those of their bytes.
            lines = F.split(F.decode(F.substring(whole, block * width + 1, F.lit(width)), "ISO-8859-1"), "\n", -1)
            ends = F.aggregate(
                lines, F.array(F.lit(0)), lambda done, line: F.array_append(done, F.element_at(done, -1) + F.length(line) + 1)
            )

            def firsts(at: Column) -> Column:
                """The first line feed of every ``size`` bytes; the last end is none."""
                window = lambda end: F.floor((end - 1) / size)
                kept = F.filter(
                    F.slice(at, 2, F.size(at) - 2),
                    lambda end, i: (block * width + end > size) & ((i == 0) | (window(end) != window(F.get(at, i)))),
                )
                return F.transform(kept, lambda end: block * width + end)

            return F.element_at(F.transform(F.array(ends), firsts), 1)

        if size < FEW_BYTES:
            width = BLOCK_BYTES // size * size
            breaks = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((length - 1) / width).cast("int")), breaks_of))
        else:
            breaks = F.array_compact(F.transform(F.sequence(F.lit(1), ((length - 1) / size).cast("int")), break_in))
        inner = F.when(length > size, breaks).otherwise(F.array().cast("array<int>"))
        # The last line's feed may be such a break as well, and nothing is behind it.
        ends = F.concat(F.filter(inner, lambda at: at < length), F.array(length))
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        return F.zip_with(starts, ends, lambda a, b: F.substring(whole, a + 1, b - a).cast("string"))

    # One element, so that the bytes are taken from the text only once.
    parts = F.element_at(F.transform(F.array(text.cast("binary")), cut), 1)
    return F.when(text.isNotNull(), parts)


def join_segments(parts: Column, collapse: bool) -> Column:
    """Segments that were worked on, as one text again.

    With ``collapse`` a blank line at a segment's start goes where the segment
    before ends with one.
    """
    if not collapse:
        return F.array_join(parts, "")

    def closed(part: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)
        seam = (i > 0) & part.startswith("\n") & ((before == "\n") | before.endswith("\n\n"))
        return F.when(seam, F.substring(part, F.lit(2), F.length(part))).otherwise(part)

    return F.array_join(F.transform(parts, closed), "")


def _by_line(options: JobOptions) -> bool:
    """Whether no step of these options can reach over a line end."""
    return not (options.mask_user_paths and any("\n" in s for s in (options.home_dir, options.user_name)))


def transform_segmented(
    df: DataFrame, options: JobOptions, name: str = "content", ext: str = "ext",
    size: int = SEGMENT_BYTES, copies: int = COPIES_PER_TASK,
) -> DataFrame:
    """:func:`~corpusmill.functions.text.transform_column`, long texts in segments.

    Texts up to ``size`` bytes (and null) are worked on where they are.  A longer one is
    cut; the segments of equal texts are worked on once, dealt over all tasks,
    and put together by digest; rows of a text that more than ``copies`` rows
    hold are put together in slots.  Python files that become skeletons are
    parsed whole, so they are not cut before that; their outlines are not long.
    Long texts are written down once, so a job runs while the plan is built.
    """
    if not _by_line(options):
        return steps.transform_column(df, options, name, ext)
    long = F.coalesce(F.octet_length(name) > size, F.lit(False))
    if options.processing_depth == "skeleton":
        long = long & ~F.coalesce(is_python(F.col(ext)), F.lit(False))
    whole = steps.transform_column(df.where(~long), options, name, ext)

    same = ["_digest", "_ext"]
    found = df.where(long).withColumns({"_digest": F.unhex(F.sha2(name, 256)), "_ext": F.coalesce(ext, F.lit(""))})
    pieces = stored(
        found.select(*same, F.posexplode(line_segments(F.col(name), size)).alias("_nth", "_part"))
        # Every copy of a text has the same pieces: one of each goes on.
        .groupBy(*same, "_nth").agg(F.any_value("_part").alias("_part"))
    )
    by_line = options.with_(processing_depth="full")
    done = steps.transform_column(pieces, by_line, "_part", "_ext")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("_nth", "_part"))), lambda p: p["_part"])
    # The parts of one text alone meet in a task, as many bytes as the text has.
    texts = done.groupBy(*same).agg(parts.alias("_parts")).select(
        *same, join_segments(F.col("_parts"), options.minify_output).alias(name)
    )
    members = stored(found.withColumn("_row", F.monotonically_increasing_id()).drop(name))
    rows = members.groupBy(*same).agg(F.count("*").alias("_copies"))
    joined = spread_lookup(members, texts.join(rows, same), same, "_row", "_copies", copies)
    return whole.unionByName(joined.select(*df.columns))
