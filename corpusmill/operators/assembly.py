"""Documents as ordered blocks: categories, the unified context, error reports.

A document is never one string.  It is a table of blocks
``(project, section, sort_key, ord, value)``; sorting by those keys and writing
``value`` plus a line feed per row gives the file.  A project of any size is
thus spread over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.tokens import tokens_from_chars
from ..scale import prefix_sums

ORDER = ["project", "section", "sort_key", "ord"]
# Place of each part in the unified document.
TITLE, TREE = 0, 1
SECTIONS = {"module": 2, "test": 3, "resource": 4}

# ord within a section: heading, body, trailer.
_HEAD, _BODY, _TAIL = -1, 0, 1
_LAST_KEY = "\U0010ffff"


def entry_block(rel_path: Column, content: Column) -> Column:
    """One file's entry, with its final line feed: rule, path, content."""
    nl = F.lit("\n")
    return F.concat(F.lit(fv.ENTRY_RULE), nl, rel_path, nl, content, nl)


def _section(target: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    return F.try_element_at(known, target)


def _heading(target: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in fv.SECTION_TITLES.items() for x in pair])
    return F.try_element_at(known, target)


def category_blocks(processed: DataFrame) -> DataFrame:
    """Heading and entries of each category that has any file.

    ``processed`` holds the written files: ``(project, rel_path, target, content)``.
    Entries are ordered by path.
    """
    return category_heads(processed).unionByName(category_entries(processed))


def category_entries(processed: DataFrame) -> DataFrame:
    """The entries of all written files, one block each."""
    return _entries(processed, F.concat(_entry_top(), F.col("content")).alias("value"))


def category_heads(processed: DataFrame) -> DataFrame:
    """One heading for each category that has any file."""
    return processed.select("project", "target").distinct().select(
        "project", "target", _section(F.col("target")).alias("section"),
        F.lit("").alias("sort_key"), F.lit(_HEAD).alias("ord"),
        _heading(F.col("target")).alias("value"),
    )


def _entry_top() -> Column:
    return F.concat(F.lit(fv.ENTRY_RULE + "\n"), F.col("rel_path"), F.lit("\n"))


def _entries(processed: DataFrame, *values: Column) -> DataFrame:
    return processed.select(
        "project", "target", _section(F.col("target")).alias("section"),
        F.col("rel_path").alias("sort_key"), F.lit(_BODY).alias("ord"), *values,
    )


def line_feeds(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def block_sizes(blocks: DataFrame) -> DataFrame:
    """Blocks with their measures instead of their text, final line feed included."""
    return blocks.withColumns({
        "n_chars": F.length("value").cast("bigint") + 1, "n_lines": line_feeds(F.col("value")) + 1,
    }).drop("value")


def entry_sizes(processed: DataFrame) -> DataFrame:
    """Measures of the entries, from ``n_chars`` and ``n_lines`` (line feeds) of each content."""
    top = _entry_top()
    return _entries(
        processed, (F.length(top) + F.col("n_chars") + 1).alias("n_chars"),
        (line_feeds(top) + F.col("n_lines") + 1).alias("n_lines"),
    )


def unified_blocks(
    projects: DataFrame, processed: DataFrame, tree: DataFrame | None = None,
    treeless: DataFrame | None = None,
) -> DataFrame:
    """All blocks of each project's unified document.

    Title, tree (if given), then modules, tests and resources; categories
    without files are left out.  ``tree`` holds the rendered lines, ``treeless``
    names the projects that have none.
    """
    outline = unified_outline(projects, processed, tree, treeless)
    return outline.unionByName(category_entries(processed).drop("target"))


def unified_outline(
    projects: DataFrame, processed: DataFrame, tree: DataFrame | None = None,
    treeless: DataFrame | None = None,
) -> DataFrame:
    """All blocks of the unified document but the entries of files."""
    heads = category_heads(processed)
    blocks = _title(projects).unionByName(heads.drop("target")).unionByName(_tails(heads))
    if tree is not None:
        blocks = blocks.unionByName(tree_blocks(tree)).unionByName(_tree_frame(projects, tree, treeless))
    return blocks


def tree_blocks(tree: DataFrame) -> DataFrame:
    return tree.select(
        "project", F.lit(TREE).alias("section"), "sort_key", "ord", F.col("line").alias("value")
    )


def unified_sizes(
    projects: DataFrame, processed: DataFrame, tree: DataFrame | None = None,
    treeless: DataFrame | None = None,
) -> DataFrame:
    """The blocks of :func:`unified_blocks` as ``(project, section, sort_key, ord, n_chars, n_lines)``.

    Reads no content: ``processed`` holds ``(project, rel_path, target, n_chars,
    n_lines)`` of the written files, ``tree`` the sizes of the tree's lines.
    """
    heads = category_heads(processed)
    small = _title(projects).unionByName(heads.drop("target")).unionByName(_tails(heads))
    sizes = entry_sizes(processed).drop("target")
    if tree is not None:
        small = small.unionByName(_tree_frame(projects, tree, treeless))
        body = tree.select(
            "project", F.lit(TREE).alias("section"), "sort_key", "ord", "n_chars",
            F.lit(1).cast("bigint").alias("n_lines"),
        )
        sizes = sizes.unionByName(body)
    return block_sizes(small).unionByName(sizes)


def _title(projects: DataFrame) -> DataFrame:
    return projects.select(
        "project", F.lit(TITLE).alias("section"), F.lit("").alias("sort_key"),
        F.lit(_HEAD).alias("ord"),
        F.concat(F.lit(fv.CONTEXT_TITLE), F.col("project"), F.lit(f"\n{fv.TITLE_RULE}\n")).alias("value"),
    )


def _tails(heads: DataFrame) -> DataFrame:
    return heads.select(
        "project", "section", F.lit(_LAST_KEY).alias("sort_key"),
        F.lit(_TAIL).alias("ord"), F.lit("\n").alias("value"),
    )


def _tree_frame(projects: DataFrame, tree: DataFrame, treeless: DataFrame | None) -> DataFrame:
    """What stands around the lines of a tree."""
    section = F.lit(TREE).alias("section")
    head = projects.select(
        "project", section, F.lit("").alias("sort_key"), F.lit(_HEAD).alias("ord"),
        F.lit(f"{fv.TREE_TITLE}\n{fv.TREE_RULE}").alias("value"),
    )
    # A project without a single node still has one, empty, line.
    if treeless is None:
        treeless = projects.join(tree.select("project").distinct(), "project", "left_anti")
    bare = treeless.select(
        "project", section, F.lit("").alias("sort_key"), F.lit(_BODY).alias("ord"),
        F.lit("").alias("value"),
    )
    tail = projects.select(
        "project", section, F.lit(_LAST_KEY).alias("sort_key"), F.lit(_TAIL).alias("ord"),
        F.lit("\n").alias("value"),
    )
    return head.unionByName(bare).unionByName(tail)


def error_blocks(errors: DataFrame) -> DataFrame:
    """Report of failed files; projects without errors get no report."""
    head = errors.select("project").distinct().select(
        "project", F.lit(0).alias("section"), F.lit("").alias("sort_key"),
        F.lit(_HEAD).alias("ord"), F.lit(f"{fv.ERRORS_TITLE}\n{fv.TITLE_RULE}").alias("value"),
    )
    body = errors.select(
        "project", F.lit(0).alias("section"), F.col("rel_path").alias("sort_key"),
        F.lit(_BODY).alias("ord"),
        F.concat(
            F.lit("FILE: "), F.col("rel_path"), F.lit("\nERROR: "), F.col("error"),
            F.lit(f"\n{fv.ERROR_RULE}"),
        ).alias("value"),
    )
    return head.unionByName(body)


def document_tokens(sizes: DataFrame) -> DataFrame:
    """Heuristic tokens of each whole document, from the sizes of its blocks."""
    return sizes.groupBy("project").agg(tokens_from_chars(F.sum("n_chars")).alias("token_count"))


def document_map(sizes: DataFrame) -> DataFrame:
    """Where each block stands: adds ``start`` (characters before it) and ``first_line`` (from 1).

    A project of any size is spread over the ranges it needs.  Blocks of equal
    keys are ordered by size.  No text is involved.
    """
    named = sizes.withColumn("project", F.coalesce("project", F.lit("")))
    placed = prefix_sums(
        named, [*ORDER[1:], "n_chars", "n_lines"], {"start": "n_chars", "lines": "n_lines"}, within=("project",)
    )
    return placed.select(*ORDER, "start", "n_chars", (F.col("lines") + 1).alias("first_line"), "n_lines")


def ordered(blocks: DataFrame) -> DataFrame:
    """Blocks in document order, range-partitioned on the whole key."""
    return blocks.orderBy(*ORDER)
