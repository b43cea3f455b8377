"""Which files of a corpus are taken, and what kind of file each one is.

Every function adds columns to, or filters, a files table
``(project, rel_path, content, ...)`` whose key is ``(project, rel_path)``.
Only names are looked at, so nothing here reads file content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import names
from ..options import JobOptions
from ..scale import small_side, spread_lookup

IGNORE = "ignore"


def with_name_parts(files: DataFrame) -> DataFrame:
    """Add ``file_name``, ``ext``, ``is_test`` and ``is_resource``."""
    return (
        files.withColumn("file_name", names.base_name(F.col("rel_path")))
        .withColumn("ext", names.extension(F.col("file_name")))
        .withColumn("is_test", names.is_test(F.col("file_name")))
        .withColumn("is_resource", names.is_resource(F.col("file_name"), F.col("ext")))
    )


# -- ignore files -----------------------------------------------------------

def ignore_rules(files: DataFrame, mode: str = "basename_suffix") -> DataFrame:
    """One row per rule of each project's root ``.gitignore``.

    Blank lines and ``#`` lines are skipped: ``(project, rule_no, rule, regex)``.
    """
    lines = (
        files.where(F.col("rel_path") == ".gitignore")
        .select("project", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
        .withColumn("rule", F.regexp_replace("line", r"(?U)\A\s+|\s+\z", ""))
    )
    return lines.where((F.col("rule") != "") & ~F.col("rule").startswith("#")).select(
        "project",
        F.col("line_no").alias("rule_no"),
        "rule",
        names.glob_to_regex(F.col("rule"), mode).alias("regex"),
    )


def ignore_patterns(files: DataFrame, mode: str = "basename_suffix") -> DataFrame:
    """What each project with rules ignores: ``(project, ignore)``.

    ``ignore`` holds the ends of names that plain rules tell (``*.log``), whole
    ``names``, and one alternation ``regex`` of the globs that are left, null if
    there are none.  Built inside the row of the ignore file, so no rows are
    grouped.
    """
    rules = F.filter(
        F.transform(
            F.split("content", "\n"),
            lambda line: F.regexp_replace(line, r"(?U)\A\s+|\s+\z", ""),
        ),
        lambda rule: (rule != "") & ~rule.startswith("#"),
    )
    listed = files.where(F.col("rel_path") == ".gitignore").select(
        "project", F.array_distinct(rules).alias("rules")
    )
    plain = F.filter("rules", names.is_plain_glob)
    open_start = lambda rule: rule.startswith("*") | F.lit(mode == "basename_suffix")
    globs = F.filter("rules", lambda rule: ~names.is_plain_glob(rule))
    regexes = F.transform(globs, lambda rule: names.glob_to_regex(rule, mode))
    ignore = F.struct(
        F.transform(F.filter(plain, open_start), names.plain_part).alias("ends"),
        F.transform(F.filter(plain, lambda rule: ~open_start(rule)), names.plain_part).alias("names"),
        F.when(F.size(regexes) > 0, F.array_join(regexes, "|")).alias("regex"),
    )
    return listed.where(F.size("rules") > 0).select("project", ignore.alias(IGNORE))


def with_ignore_patterns(files: DataFrame, mode: str = "basename_suffix") -> DataFrame:
    """Give every file what its project ignores (null where there is nothing).

    The rules are written down and measured first: joined by broadcast when
    small, so that file content stays where it is.  Rules of very many projects
    are joined by shuffle, with the files of large projects spread out.
    """
    rules, small = small_side(ignore_patterns(files, mode))
    if small:
        return files.join(rules, "project", "left")
    sizes = files.groupBy("project").agg(F.count("*").alias("n_files"))
    return spread_lookup(
        files, rules.join(sizes, "project"), ["project"], "rel_path", "n_files"
    )


# -- predicates -------------------------------------------------------------

def _ignored(name: Column) -> Column:
    """Ends and whole names first; a regex only where a project has other globs."""
    ignore = F.col(IGNORE)
    hit = (
        F.exists(ignore["ends"], lambda end: name.endswith(end))
        | F.array_contains(ignore["names"], name)
        | F.coalesce(F.rlike(name, ignore["regex"]), F.lit(False))
    )
    return F.when(ignore.isNotNull(), hit).otherwise(False)


def _ignored_dir(path: Column) -> Column:
    folders = names.directory(path)
    return (folders != "") & F.exists(F.split(folders, "/"), _ignored)


def excluded(files: DataFrame, patterns: tuple[str, ...]) -> Column:
    name = F.col("file_name")
    hit = names.hits_any(name, patterns)
    return hit | _ignored(name) if IGNORE in files.columns else hit


def prune_dirs(files: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Drop files below an excluded directory; they are not even counted."""
    path = F.col("rel_path")
    kept = files.where(~names.has_excluded_dir(path, patterns))
    return kept.where(~_ignored_dir(path)) if IGNORE in files.columns else kept


def eligible(options: JobOptions) -> Column:
    """Scan rule: resource, else test, else listed extension.

    A disabled test or resource falls through to the extension rule.
    """
    rule = F.lit(False)
    if options.process_modules:
        rule = names.has_listed_extension(
            F.col("file_name"), F.col("ext"), options.extensions
        )
    if options.process_tests:
        rule = F.col("is_test") | rule
    if options.process_resources:
        rule = F.col("is_resource") | rule
    return rule


def target(options: JobOptions) -> Column:
    """Category a file is written to: test, resource, module or skip."""
    if not options.process_modules:
        return F.lit("skip")
    return (
        F.when(F.col("is_test"), "test" if options.process_tests else "skip")
        .when(F.col("is_resource"), "resource" if options.process_resources else "module")
        .otherwise("module")
    )


def tree_admits(files: DataFrame, options: JobOptions) -> Column:
    """Tree rule: not excluded, included, listed extension, and the mode."""
    rule = (
        ~excluded(files, options.exclude_patterns)
        & names.hits_any(F.col("file_name"), options.include_patterns)
        & (F.col("ext").isin(*options.extensions) if options.extensions else F.lit(False))
    )
    if options.tree_mode == "tests_only":
        return rule & F.col("is_test")
    if options.tree_mode == "modules_only":
        return rule & ~F.col("is_test")
    if options.tree_mode != "all":
        raise ValueError(f"unknown tree mode {options.tree_mode!r}")
    return rule


def checked_options(
    spark: SparkSession, options: JobOptions, dropped: list[str] | None = None
) -> JobOptions:
    """The options without patterns the regex engine cannot compile (listed in ``dropped``)."""
    return options.with_(
        include_patterns=tuple(names.valid_patterns(spark, options.include_patterns, dropped)),
        exclude_patterns=tuple(names.valid_patterns(spark, options.exclude_patterns, dropped)),
    )


def scan(files: DataFrame, options: JobOptions) -> DataFrame:
    """Classify every file that is not below an excluded directory.

    Adds ``status`` (``process`` or ``skipped``), ``target`` and ``in_tree``.
    A file can be admitted here and still have the target ``skip``; such files
    are reported as rejected.
    """
    options = checked_options(files.sparkSession, options)
    if options.respect_gitignore:
        files = with_ignore_patterns(files, options.glob_mode)
    files = prune_dirs(with_name_parts(files), options.exclude_patterns)
    taken = (
        ~excluded(files, options.exclude_patterns)
        & names.hits_any(F.col("file_name"), options.include_patterns)
        & eligible(options)
    )
    return (
        files.withColumn("status", F.when(taken, "process").otherwise("skipped"))
        .withColumn("target", target(options))
        .withColumn("in_tree", tree_admits(files, options))
        .drop(IGNORE)
    )


# -- stacks -----------------------------------------------------------------

def stacks_of(suffix: Column) -> Column:
    """Names of the technology presets that list an extension or file name."""
    listed: dict[str, list[str]] = {}
    for stack, suffixes in fv.STACK_PRESETS.items():
        for item in suffixes:
            listed.setdefault(item, []).append(stack)
    pairs = [(F.lit(item), F.array(*[F.lit(s) for s in names_])) for item, names_ in listed.items()]
    return F.try_element_at(F.create_map(*[part for pair in pairs for part in pair]), suffix)


def match_stacks(files: DataFrame) -> DataFrame:
    """One row per file and stack that lists its extension or its whole name.

    The presets are a fixed, small map: no join is needed.
    """
    found = F.array_union(
        F.coalesce(stacks_of(F.col("ext")), F.array().cast("array<string>")),
        F.coalesce(stacks_of(F.col("file_name")), F.array().cast("array<string>")),
    )
    return files.withColumn("stack", F.explode(found))
