"""Counters and summaries: one row per project, from one pass over statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import JobOptions


def run_counters(results: DataFrame) -> DataFrame:
    """Counts per project over ``(project, status, target, cached, n_tokens)``.

    ``status`` is ok, skipped, rejected or failed.  Rejected and failed files
    both count as errors.
    """
    ok = F.col("status") == "ok"
    wrote = lambda target: F.count_if(ok & (F.col("target") == target))
    return results.groupBy("project").agg(
        F.count_if(ok).alias("processed"),
        F.count_if(ok & F.col("cached")).alias("cached"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status").isin("rejected", "failed")).alias("errors"),
        F.coalesce(F.sum(F.when(ok, F.col("n_tokens"))), F.lit(0)).cast("bigint").alias("total_tokens"),
        wrote("module").alias("modules_written"),
        wrote("test").alias("tests_written"),
        wrote("resource").alias("resources_written"),
    )


def target_counts(results: DataFrame) -> DataFrame:
    """Files written per project and category, one column per category."""
    return run_counters(results).select(
        "project", "modules_written", "tests_written", "resources_written"
    )


def run_summary(
    counters: DataFrame, options: JobOptions, document_tokens: DataFrame | None,
    tree_lines: DataFrame | None, dry_run: bool = False,
) -> DataFrame:
    """One summary row per project; joins only per-project aggregates."""
    row = counters
    if document_tokens is not None:
        row = row.join(document_tokens, "project", "left")
    else:
        row = row.withColumn("token_count", F.lit(None).cast("bigint"))
    if tree_lines is not None:
        row = row.join(tree_lines, "project", "left")
    else:
        row = row.withColumn("tree_lines", F.lit(None).cast("bigint"))

    made = [
        F.when(F.col(f"{kind}_written") > 0, F.lit(f"{options.output_prefix}_{kind}"))
        for kind in ("modules", "tests", "resources")
        if options.create_individual_files
    ]
    if options.create_unified_file:
        made.append(F.lit(f"{options.output_prefix}_full_context"))
    planned = options.planned_outputs() if dry_run else []
    text_list = "array<string>"
    return (
        row.withColumn("token_count", F.coalesce("token_count", F.lit(0)))
        .withColumn("tree_lines", F.coalesce("tree_lines", F.lit(0)))
        .withColumn("ok", F.lit(True))
        .withColumn("processing_depth", F.lit(options.processing_depth))
        .withColumn("tree_generated", F.lit(options.generate_tree))
        .withColumn("unified_generated", F.lit(options.create_unified_file))
        .withColumn("generated", F.array_compact(F.array(*made)).cast(text_list))
        .withColumn("dry_run", F.lit(dry_run))
        .withColumn("will_generate", F.array(*[F.lit(p) for p in planned]).cast(text_list))
        .withColumn("sanitizer", F.lit(options.enable_sanitizer))
        .withColumn("mask_paths", F.lit(options.mask_user_paths))
        .withColumn("minifier", F.lit(options.minify_output))
    )


def summary_json(summary: DataFrame) -> DataFrame:
    return summary.select("project", F.to_json(F.struct("*")).alias("summary"))
