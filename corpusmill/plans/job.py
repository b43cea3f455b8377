"""A whole run: scan, reuse, transform, assemble, write, report."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.pycode import SYMBOL_TYPE
from ..functions.text import transform_column
from ..functions.tokens import model_tokens, token_method
from ..operators import assembly, counters, filtering, reuse, segments, shared_text, tree
from ..options import JobOptions
from ..scale import new_folder, remove, tables_in
from . import publish

def process(
    files: DataFrame,
    options: JobOptions,
    cache: reuse.Stored | None = None,
    vocabulary_dir: str | None = None,
    digest: str = "content",
    share_texts: bool = False,
    segment_bytes: int | None = None,
) -> DataFrame:
    """Every scanned file with its fate and, where it is taken, its new text.

    ``files`` is ``(project, rel_path, content[, mtime, length, error])`` with
    text content; ``error`` marks files the source could not read.  Files found
    in ``cache`` take their stored text; only the others are transformed, with
    ``share_texts`` once for each text that several files have, and with
    ``segment_bytes`` in segments where a text is longer than that.
    """
    if "error" not in files.columns:
        files = files.withColumn("error", F.lit(None).cast("string"))
    scanned = filtering.scan(files, options)
    # Files that are not taken keep their row and lose their text, so that one
    # pass over the corpus yields everything.
    taken = (F.col("status") == "process") & (F.col("target") != "skip") & F.col("error").isNull()
    marked = scanned.withColumn("taken", taken)

    def finish(df: DataFrame) -> DataFrame:
        df = tree.with_symbols(df, options)
        text = F.coalesce("content", F.lit(""))
        df = df.withColumn("content", F.when(F.col("taken"), text))
        return reuse.with_fingerprint(df, options, digest)

    if cache is None or cache == []:
        found, rest = None, finish(marked)
    else:
        found, rest = reuse.split(marked, cache, finish)

    def change(df: DataFrame) -> DataFrame:
        if segment_bytes is None:
            changed = transform_column(df, options)
        else:
            changed = segments.transform_segmented(df, options, size=segment_bytes)
        tokens = model_tokens(F.col("content"), options.target_model, vocabulary_dir)
        return changed.withColumn("n_tokens", tokens)

    if share_texts:
        fresh = shared_text.transform_once(rest, change, by=("ext",), made=("content", "n_tokens"))
    else:
        fresh = change(rest)
    done = _result(fresh, cached=False)
    return done if found is None else done.unionByName(_result(found, cached=True))


def _result(df: DataFrame, cached: bool) -> DataFrame:
    if "symbols" not in df.columns:
        df = df.withColumn("symbols", F.lit(None).cast(SYMBOL_TYPE))
    fate = (
        F.when(F.col("taken"), "ok")
        .when(F.col("status") == "skipped", "skipped")
        .when(F.col("target") == "skip", "rejected")
        .otherwise("failed")
    )
    reason = F.when(fate == "rejected", fv.REJECTED_MESSAGE).when(fate == "failed", F.col("error"))
    only_taken = lambda name: F.when(F.col("taken"), F.col(name)).alias(name)
    # Kept beside the text, so that documents can be measured without reading it.
    n_chars, n_lines = F.length("content").cast("bigint"), assembly.line_feeds(F.col("content"))
    return df.select(
        "project", "rel_path", fate.alias("status"), "target", "in_tree", "symbols",
        F.lit(cached).alias("cached"), "content", only_taken("n_tokens"),
        only_taken("fingerprint"), reason.alias("error"),
        F.when(F.col("taken"), n_chars).alias("n_chars"), F.when(F.col("taken"), n_lines).alias("n_lines"),
    )


@dataclass
class Job:
    """The frames of a run, all derived from one results table.

    ``place`` is the folder of that table and of those that frames need; it
    stays until :meth:`close`, after which the frames cannot be read any more.
    """

    results: DataFrame
    options: JobOptions
    place: str | None = None

    def close(self) -> None:
        if self.place is not None:
            remove(self.results.sparkSession, self.place)

    @property
    def written(self) -> DataFrame:
        return self.results.where("status = 'ok'").select(
            "project", "rel_path", "target", "content"
        )

    @property
    def errors(self) -> DataFrame:
        return self.results.where("error is not null").select("project", "rel_path", "error")

    @property
    def projects(self) -> DataFrame:
        return self.results.select("project").distinct()

    @property
    def tree_files(self) -> DataFrame:
        columns = ["project", "rel_path"] + (["symbols"] if self.options.wants_symbols else [])
        return self.results.where("in_tree").select(*columns)

    @cached_property
    def tree(self) -> DataFrame:
        with tables_in(self.place):
            return tree.tree_lines(self.tree_files)

    @property
    def categories(self) -> DataFrame:
        return assembly.category_blocks(self.written)

    @property
    def treeless(self) -> DataFrame:
        drawn = self.results.groupBy("project").agg(F.bool_or("in_tree").alias("drawn"))
        return drawn.where("not drawn").select("project")

    @property
    def tree_blocks(self) -> DataFrame:
        return assembly.tree_blocks(self.tree)

    @property
    def outline(self) -> DataFrame:
        """The unified document's blocks without the entries of files."""
        if not self.options.generate_tree:
            return assembly.unified_outline(self.projects, self.written)
        return assembly.unified_outline(self.projects, self.written, self.tree, self.treeless)

    @property
    def unified(self) -> DataFrame:
        return self.outline.unionByName(assembly.category_entries(self.written).drop("target"))

    @property
    def sizes(self) -> DataFrame:
        """Sizes of the unified document's blocks, without reading or drawing them."""
        written = self.results.where("status = 'ok'").select(
            "project", "rel_path", "target", "n_chars", "n_lines"
        )
        if not self.options.generate_tree:
            return assembly.unified_sizes(self.projects, written)
        lines = tree.tree_line_sizes(self.tree_files)
        return assembly.unified_sizes(self.projects, written, lines, self.treeless)

    @property
    def map(self) -> DataFrame:
        """Character offset and line range of every block of the unified document."""
        with tables_in(self.place):
            return assembly.document_map(self.sizes)

    @property
    def counters(self) -> DataFrame:
        return counters.run_counters(self.results)

    def summary(self, dry_run: bool = False) -> DataFrame:
        tokens = assembly.document_tokens(self.sizes) if self.options.create_unified_file else None
        lines = tree.tree_line_counts(self.tree_files) if self.options.generate_tree else None
        return counters.run_summary(self.counters, self.options, tokens, lines, dry_run)


@dataclass
class Report:
    """What a run did.  ``summary`` has one row per project.

    :meth:`close` deletes the run's intermediate tables, which ``summary`` and
    ``job`` read; outputs and cache stay.
    """

    ok: bool
    output_path: str
    error: str = ""
    existing: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    planned: list[str] = field(default_factory=list)
    dropped_patterns: list[str] = field(default_factory=list)
    summary: DataFrame | None = None
    job: Job | None = None

    def close(self) -> None:
        if self.job is not None:
            self.job.close()


def run(
    files: DataFrame,
    options: JobOptions,
    *,
    overwrite: bool = False,
    dry_run: bool = False,
    cache: reuse.ResultCache | None = None,
    vocabulary_dir: str | None = None,
    digest: str = "content",
    share_texts: bool = False,
    segment_bytes: int | None = None,
) -> Report:
    """Process a corpus and write the documents the options ask for.

    The results are written down once, in the shared folder; every document,
    tree and counter is then derived from that table.  A dry run computes the
    same summary; it writes no documents, and its results keep sizes and no text.
    Intermediate tables stay until ``Report.close()``; a run that fails leaves none.
    """
    spark = files.sparkSession
    out = options.output_path()
    planned = options.planned_outputs()
    # A set that an earlier run has committed and not yet moved is moved now.
    publish.finish(spark, out, options.output_prefix)
    existing = publish.existing_outputs(spark, out, planned)
    dropped: list[str] = []
    options = filtering.checked_options(spark, options, dropped)
    if existing and not overwrite and not dry_run:
        return Report(False, out, "output files exist and overwrite is off", existing, planned=planned,
                      dropped_patterns=dropped)

    place = new_folder(spark)
    try:
        with tables_in(place):
            method = token_method(options.target_model, vocabulary_dir)
            known = cache.tables(options, method) if cache is not None else None
            results = process(files, options, known, vocabulary_dir, digest, share_texts, segment_bytes)
            (results.drop("content") if dry_run else results).write.parquet(f"{place}/results")
            job = Job(spark.read.parquet(f"{place}/results"), options, place)

            outputs: list[str] = []
            if not dry_run:
                outputs = _write(job, out)
                if cache is not None:
                    fresh = job.results.where("status = 'ok' and not cached").select(
                        "fingerprint", "project", "rel_path", "content", "n_tokens",
                        F.current_timestamp().alias("created_at"),
                    )
                    cache.append(fresh, options, method)
            summary = job.summary(dry_run)
    except BaseException:
        remove(spark, place)
        raise
    return Report(
        True, out, existing=existing, outputs=outputs,
        planned=planned if dry_run else [], dropped_patterns=dropped, summary=summary, job=job,
    )


def _write(job: Job, out: str) -> list[str]:
    """All documents in one job: the stored text is read once and sorted once."""
    options, prefix = job.options, job.options.output_prefix
    name = lambda kind: f"{prefix}_{kind}"
    outputs: dict[str, DataFrame] = {}
    places = []
    if options.create_individual_files:
        heads = assembly.category_heads(job.written)
        for kind, target, wanted in (
            ("modules", "module", options.process_modules),
            ("tests", "test", options.process_tests),
            ("resources", "resource", options.process_resources),
        ):
            if wanted:
                outputs[name(kind)] = heads.where(F.col("target") == target)
                places.append(F.when(F.col("target") == target, F.lit(name(kind))))
        if options.generate_tree:
            outputs[name("tree")] = job.tree_blocks.withColumn("section", F.lit(0))
    if options.create_unified_file:
        outputs[name("full_context")] = job.outline
        places.append(F.lit(name("full_context")))
    if options.save_error_log and not job.errors.isEmpty():
        outputs[name("errors")] = assembly.error_blocks(job.errors)
    if not outputs:
        return []
    shared = None
    if places:
        shared = assembly.category_entries(job.written).withColumn("outputs", F.array_compact(F.array(*places)))
    publish.publish(outputs, shared, out, prefix)
    return [f"{out}/{listed}" for listed in outputs]
