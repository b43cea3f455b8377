"""Directory trees as tables: nodes, rendered lines, symbol lines.

A tree is never built as a nested object.  Rows carry ``sort_key``, the path
with its slashes turned into the lowest character, so sorting by
``(project, sort_key, ord)`` gives pre-order with siblings by code point.

Work is done per directory wherever possible.  File rows meet their directory
in one join: by broadcast if the table of directories measures small, else by
shuffle, with directories of very many files split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import names, pycode
from ..options import JobOptions
from ..scale import (
    BROADCAST_LIMIT_BYTES, HOT_KEY_ROWS, measured_bytes, small_side, spread_lookup, stored,
)

_KEY = ["project", "dir"]


def _depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1


def _sort_key(path: Column) -> Column:
    return F.translate(path, "/", "\u0001")


def _ancestors(path: Column) -> Column:
    """All leading parts of a path, shortest first, itself last."""
    return F.transform(
        F.sequence(F.lit(1), _depth(path)),
        lambda i: F.call_function("substring_index", path, F.lit("/"), i),
    )


def _file_stats(files: DataFrame) -> DataFrame:
    """Per directory that holds files: its last file name and how many."""
    return files.groupBy(
        "project", names.directory(F.col("rel_path")).alias("dir")
    ).agg(
        F.max(names.base_name(F.col("rel_path"))).alias("last_child"),
        F.count("*").alias("n_children"),
    )


def _folders(stats: DataFrame) -> DataFrame:
    """Every directory, the root included, with its last entry and their number.

    ``(project, dir, last_child, n_children)``, from one row per directory that
    holds files.
    """
    inner = (
        stats.where(F.col("dir") != "")
        .select("project", F.explode(_ancestors(F.col("dir"))).alias("path"))
        .distinct()
    )
    sub = inner.groupBy("project", names.directory(F.col("path")).alias("dir")).agg(
        F.max(names.base_name(F.col("path"))).alias("last_child"),
        F.count("*").alias("n_children"),
    )
    return (
        stats.unionByName(sub)
        .groupBy(*_KEY)
        .agg(F.max("last_child").alias("last_child"), F.sum("n_children").alias("n_children"))
    )


def tree_nodes(files: DataFrame) -> DataFrame:
    """Directories and files of each tree: ``(project, path, depth, kind)``.

    Empty directories never appear, as nodes come only from files.
    """
    path = F.col("path")
    dirs = (
        _file_stats(files).where(F.col("dir") != "")
        .select("project", F.explode(_ancestors(F.col("dir"))).alias("path"))
        .distinct()
        .select("project", "path", F.lit("dir").alias("kind"))
    )
    leaves = files.select("project", F.col("rel_path").alias("path"), F.lit("file").alias("kind"))
    return dirs.unionByName(leaves).select("project", "path", _depth(path).alias("depth"), "kind")


def _with_prefixes(folders: DataFrame, hot_rows: int | None) -> DataFrame:
    """Add to every directory its own line and what stands before its entries.

    Without ``hot_rows`` the directories are few: plain joins, nothing stored.
    """
    few = hot_rows is None

    def lookup(left, right, keys, spread_by, weight):
        if few:
            return left.join(right.drop(weight), keys, "left")
        return spread_lookup(left, right, keys, spread_by, weight, hot_rows)

    dirs = folders.where(F.col("dir") != "").select("project", F.col("dir").alias("path"))
    steps = dirs.select(
        "project", F.col("path").alias("node"), F.explode(_ancestors(F.col("path"))).alias("path")
    )
    # A directory near the root is an ancestor of very many others.
    below = steps.groupBy("project", "path").agg(F.count("*").alias("n_below"))
    flagged = lookup(
        below.withColumn("dir", names.directory(F.col("path"))),
        folders, _KEY, "path", "n_children",
    ).select(
        "project", "path", "n_below",
        (names.base_name(F.col("path")) == F.col("last_child")).alias("is_last"),
    )
    bars = lookup(
        steps, flagged if few else stored(flagged), ["project", "path"], "node", "n_below"
    )
    part = F.struct(_depth(F.col("path")).alias("depth"), F.col("is_last"))
    indent = lambda p: F.when(p["is_last"], fv.INDENT_CLOSED).otherwise(fv.INDENT_OPEN)
    prefixes = (
        # At most one element per level of the path, so the list stays short.
        bars.groupBy("project", "node").agg(F.sort_array(F.collect_list(part)).alias("levels"))
        .select(
            "project",
            F.col("node").alias("dir"),
            F.concat(
                F.array_join(
                    F.transform(F.slice("levels", 1, F.size("levels") - 1), indent), ""
                ),
                _branch(F.element_at("levels", -1)["is_last"]),
                names.base_name(F.col("node")),
            ).alias("dir_line"),
            F.array_join(F.transform("levels", indent), "").alias("prefix"),
        )
    )
    return folders.join(prefixes, _KEY, "left")


def _branch(is_last: Column) -> Column:
    return F.when(is_last, fv.BRANCH_LAST).otherwise(fv.BRANCH_MIDDLE)


def tree_lines(
    files: DataFrame, hot_rows: int = HOT_KEY_ROWS, limit: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Rendered lines ``(project, sort_key, ord, path, line)``, unsorted.

    ``files`` holds the admitted files, with an optional ``symbols`` array that
    adds one line per symbol below its file (``ord`` 1, 2, ...).  Only the first
    aggregation and the last join touch file rows.
    """
    with_symbols = "symbols" in files.columns
    stats = stored(_file_stats(files))
    if measured_bytes(stats) <= limit:
        folders = _with_prefixes(_folders(stats), None)
    else:
        folders = _with_prefixes(stored(_folders(stats)), hot_rows)
    folders, small = small_side(folders, limit)
    dir_lines = folders.where(F.col("dir") != "").select(
        "project", F.col("dir").alias("path"), F.lit(0).alias("ord"), F.col("dir_line").alias("line")
    )
    leaves = files.select(
        "project", "rel_path",
        names.directory(F.col("rel_path")).alias("dir"),
        *(["symbols"] if with_symbols else []),
    )
    if small:
        entries = leaves.join(F.broadcast(folders.drop("dir_line", "n_children")), _KEY, "left")
    else:
        entries = spread_lookup(
            leaves, folders.drop("dir_line"), _KEY, "rel_path", "n_children", hot_rows
        )
    name = names.base_name(F.col("rel_path"))
    before = F.coalesce("prefix", F.lit(""))
    is_last = name == F.col("last_child")
    own_line = F.struct(
        F.lit(0).alias("ord"), F.concat(before, _branch(is_last), name).alias("line")
    )
    lines = F.array(own_line)
    if with_symbols:
        indent = F.concat(before, F.when(is_last, fv.INDENT_CLOSED).otherwise(fv.INDENT_OPEN))
        lines = F.concat(
            lines,
            F.transform(
                "symbols",
                lambda s: F.struct(
                    (s["ord"] + 1).alias("ord"),
                    F.concat(indent, pycode.symbol_label(s["kind"], s["name"])).alias("line"),
                ),
            ),
        )
    file_lines = entries.select(
        "project", F.col("rel_path").alias("path"), F.inline(lines)
    )
    return dir_lines.unionByName(file_lines).select(
        "project", _sort_key(F.col("path")).alias("sort_key"), "ord", "path", "line"
    )


def tree_line_sizes(files: DataFrame) -> DataFrame:
    """Sizes ``(project, sort_key, ord, n_chars)`` of the lines of each tree, line feed included.

    Every level of a line is drawn in as many characters, so depth and name
    tell its size; nothing is rendered.
    """
    levels = F.col("depth") * len(fv.BRANCH_LAST)
    own = F.length(names.base_name(F.col("path")))
    lines = tree_nodes(files).select(
        "project", _sort_key(F.col("path")).alias("sort_key"), F.lit(0).alias("ord"),
        (levels + own + 1).cast("bigint").alias("n_chars"),
    )
    if "symbols" not in files.columns:
        return lines
    labelled = files.select("project", "rel_path", F.inline("symbols")).select(
        "project", _sort_key(F.col("rel_path")).alias("sort_key"), (F.col("ord") + 1).alias("ord"),
        (_depth(F.col("rel_path")) * len(fv.INDENT_OPEN) + F.length(pycode.symbol_label(F.col("kind"), F.col("name"))) + 1)
        .cast("bigint").alias("n_chars"),
    )
    return lines.unionByName(labelled)


def with_symbols(files: DataFrame, options: JobOptions, source: str = "content") -> DataFrame:
    """Add the ``symbols`` the options ask for; no request, no Python stage.

    Files outside the tree (``in_tree`` false) send no text to Python.
    """
    if not options.wants_symbols:
        return files
    text = F.col(source)
    if "in_tree" in files.columns:
        text = F.when(F.col("in_tree"), text)
    found = pycode.symbols(text, options.show_functions, options.show_classes, options.show_methods)
    if "error" in files.columns:
        # A file that could not be read has one line that says so.
        name = names.base_name(F.col("rel_path"))
        reason = F.concat(F.lit("Could not read '"), name, F.lit("': "), F.col("error"))
        unread = F.array(F.struct(
            F.lit(0).alias("ord"), F.lit("error").alias("kind"), F.lit(None).cast("string").alias("parent"),
            reason.alias("name"),
        )).cast(pycode.SYMBOL_TYPE)
        found = F.when(F.col("error").isNotNull(), unread).otherwise(found)
    return files.withColumn("symbols", found)


def symbol_rows(files: DataFrame, source: str = "content") -> DataFrame:
    """All symbols of all files as rows ``(project, rel_path, ord, kind, parent, name)``."""
    return files.select(
        "project", "rel_path", F.inline(pycode.symbols(F.col(source)))
    )


def tree_line_counts(files: DataFrame) -> DataFrame:
    """Number of lines each tree will have, without rendering it."""
    nodes = tree_nodes(files).groupBy("project").agg(F.count("*").alias("tree_lines"))
    if "symbols" not in files.columns:
        return nodes
    extra = files.groupBy("project").agg(F.sum(F.size("symbols")).alias("n_symbols"))
    return nodes.join(extra, "project").select(
        "project", (F.col("tree_lines") + F.col("n_symbols")).alias("tree_lines")
    )
