"""The registered queries: each operator over the whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, pycode, text, tokens
from ..operators import assembly, catalogue, costing, counters, filtering, reuse, segments, shared_text, tree
from ..scale import shared_dir, stored
from ..sources.corpus import from_table
from ..streaming import changes, ingest
from . import inputs, job

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

OPTIONS, CHAIN = inputs.OPTIONS, inputs.CHAIN
KEY = ["project", "rel_path"]


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _named(spark: SparkSession, sf: str, with_text: bool = False) -> DataFrame:
    return filtering.with_name_parts(inputs.files(spark, sf, with_text))


def _edge(spark: SparkSession, sf: str, change: Callable[[Column], Column]) -> DataFrame:
    rows = inputs.edge_texts(spark, sf)
    return rows.select("doc_id", change(F.col("text")).alias("text"))


# -- sources ----------------------------------------------------------------

@register
def decode_text(spark, sf):
    """Bytes with CR line ends and broken UTF-8 to clean text."""
    raw = F.concat(
        F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"),
        F.unhex(F.lit("0D8081FF0D")),
    )
    docs = inputs.table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    return docs.select("doc_id", text.read_text(F.col("raw")).alias("text"))


@register
def incremental_ingest(spark, sf):
    """The documents as a stream of files, each taken exactly once."""
    docs = inputs.table(spark, sf, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parque[t]")
    rows = from_table(
        stream.withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))),
        "source", "path", "text",
    )
    base = f"{shared_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    changed = ingest.transform_stream(rows, CHAIN)
    ingest.ingest(changed, f"{base}/table", f"{base}/offsets").awaitTermination()
    return spark.read.schema(changed.schema).parquet(f"{base}/table")


@register
def changed_states(spark, sf):
    """Documents as states of few files, met in a stream: the newest of each stays."""
    docs = inputs.table(spark, sf, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parque[t]")
    listing = stream.select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("path"),
        (F.col("n_chars") * 1000).alias("mtime"), F.octet_length("text").cast("bigint").alias("length"),
    )
    base = f"{shared_dir(spark).rstrip('/')}/states-{uuid.uuid4().hex}"
    ingest.ingest(changes.newer_states(listing), f"{base}/table", f"{base}/offsets").awaitTermination()
    taken = spark.read.schema("path string, mtime bigint, length bigint, version bigint").parquet(f"{base}/table")
    newest = taken.groupBy("path").agg(F.max(F.struct("mtime", "length")).alias("state"))
    return newest.select("path", "state.mtime", "state.length")


# -- filters ----------------------------------------------------------------

@register
def dir_prune(spark, sf):
    kept = filtering.prune_dirs(_named(spark, sf), OPTIONS.exclude_patterns)
    return kept.select(*KEY)


@register
def gitignore_rules(spark, sf):
    rules = filtering.ignore_rules(inputs.ignore_files(inputs.files(spark, sf)))
    return rules.withColumn("rule_no", F.col("rule_no").cast("bigint"))


@register
def filter_gitignore(spark, sf):
    files = inputs.files(spark, sf)
    both = files.select(*KEY, "content").unionByName(inputs.ignore_files(files))
    named = filtering.with_name_parts(filtering.with_ignore_patterns(both))
    kept = filtering.prune_dirs(named, ()).where(~filtering.excluded(named, ()))
    return kept.select(*KEY)


@register
def filter_exclude(spark, sf):
    hit = names.hits_any(F.col("file_name"), [r"^README", r"\.spec\.ts$"])
    return _named(spark, sf).where(~hit).select(*KEY)


@register
def filter_grouped(spark, sf):
    """A pattern with a group before one that refers back to its own group."""
    patterns = names.valid_patterns(spark, [r"(READ)ME", r"(?P<digit>\d)(?P=digit)\.", "("])
    return _named(spark, sf).where(~names.hits_any(F.col("file_name"), patterns)).select(*KEY)


@register
def filter_include(spark, sf):
    hit = names.hits_any(F.col("file_name"), [r"^mod_", "Test", r"\.js$"])
    return _named(spark, sf).where(hit).select(*KEY)


@register
def filter_default_noise(spark, sf):
    named = _named(spark, sf)
    return named.where(~filtering.excluded(named, OPTIONS.exclude_patterns)).select(*KEY)


@register
def filter_extension(spark, sf):
    listed = names.has_listed_extension(F.col("file_name"), F.col("ext"), (".py", ".js", "Dockerfile"))
    return _named(spark, sf).where(listed).select(*KEY)


@register
def stack_match(spark, sf):
    return filtering.match_stacks(_named(spark, sf)).select(*KEY, "stack")


@register
def tree_mode(spark, sf):
    named = _named(spark, sf)
    rule = lambda mode: filtering.tree_admits(named, OPTIONS.with_(tree_mode=mode))
    return named.select(
        *KEY, rule("all").alias("in_all"), rule("modules_only").alias("in_modules"),
        rule("tests_only").alias("in_tests"),
    )


@register
def scan_status(spark, sf):
    strict = OPTIONS.with_(process_tests=False, process_resources=False)
    found = filtering.scan(inputs.files(spark, sf), OPTIONS)
    narrow = filtering.scan(found.select(*KEY, F.col("status").alias("status_all")), strict)
    return narrow.select(*KEY, "status_all", F.col("status").alias("status_modules"))


MERGED = OPTIONS.with_(
    respect_gitignore=True, exclude_patterns=(*OPTIONS.exclude_patterns, r"^Dockerfile$", r"^test_\d*1\.py$"),
    include_patterns=(r"\.py$", r"\.(ts|js|md)$", r"^\.gitignore$", r"^\d+Test", r"Docker"),
)


@register
def scan_merged_rules(spark, sf):
    """Default and user patterns and the projects' ignore files, all at once."""
    files = inputs.files(spark, sf)
    both = files.select(*KEY, "content").unionByName(inputs.ignore_files(files))
    return filtering.scan(both, MERGED).select(*KEY, "status", "in_tree")


# -- classes ----------------------------------------------------------------

@register
def split_ext(spark, sf):
    return _named(spark, sf).select(*KEY, "file_name", "ext", names.directory(F.col("rel_path")).alias("dir"))


@register
def split_ext_urls(spark, sf):
    path = F.regexp_replace("url", r"[?#].*", "")
    pages = inputs.table(spark, sf, "pages").select("page_id", names.base_name(path).alias("file_name"))
    return pages.withColumn("ext", names.extension(F.col("file_name")))


@register
def classify_test(spark, sf):
    return _named(spark, sf).select(*KEY, "is_test")


@register
def classify_resource(spark, sf):
    return _named(spark, sf).select(*KEY, "is_resource")


@register
def route_target(spark, sf):
    way = lambda **change: filtering.target(OPTIONS.with_(**change))
    return _named(spark, sf).select(
        *KEY, way().alias("full"), way(processing_depth="skeleton").alias("skeleton"),
        way(processing_depth="tree_only").alias("tree_only"),
        way(process_tests=False).alias("no_tests"), way(process_resources=False).alias("no_resources"),
    )


# -- text -------------------------------------------------------------------

@register
def redact_api_key(spark, sf):
    return _edge(spark, sf, text.redact_api_keys)


@register
def redact_cloud_key(spark, sf):
    return _edge(spark, sf, text.redact_cloud_keys)


@register
def redact_ip(spark, sf):
    return _edge(spark, sf, text.redact_ips)


@register
def redact_email(spark, sf):
    return _edge(spark, sf, text.redact_emails)


@register
def redact_assignment(spark, sf):
    return _edge(spark, sf, text.redact_assignments)


@register
def redact_all(spark, sf):
    """All patterns over the documents as they are."""
    return text.redact_column(inputs.texts(spark, sf, "doc_id", "text"), "text")


@register
def redact_all_edges(spark, sf):
    """All patterns over documents in which every pattern occurs."""
    return text.redact_column(inputs.edge_texts(spark, sf).select("doc_id", "text"), "text")


@register
def mask_paths(spark, sf):
    return _edge(spark, sf, lambda t: text.mask_paths(t, inputs.HOME, inputs.USER))


@register
def minify_hash(spark, sf):
    return _edge(spark, sf, text.strip_hash_comments)


@register
def minify_slash(spark, sf):
    return _edge(spark, sf, text.strip_slash_comments)


@register
def minify_all(spark, sf):
    return _named(spark, sf, with_text=True).select(*KEY, text.minify(F.col("content"), F.col("ext")).alias("content"))


@register
def minify_whole(spark, sf):
    return _edge(spark, sf, lambda t: text.minify_whole(t, F.lit(".py")))


@register
def minify_reduction(spark, sf):
    small = _named(spark, sf, with_text=True).select(
        *KEY, "content", text.minify(F.col("content"), F.col("ext")).alias("small")
    )
    return small.select(*KEY, text.reduction_percent(F.col("content"), F.col("small")).alias("saved_percent"))


@register
def transform_chain(spark, sf):
    changed = text.transform_column(_named(spark, sf, with_text=True), CHAIN)
    return changed.select(*KEY, "content")


@register
def chain_skeleton(spark, sf):
    """All four steps on the files that a run takes."""
    options = CHAIN.with_(processing_depth="skeleton")
    results = job.process(inputs.files(spark, sf, with_text=True), options)
    return results.where("status = 'ok'").select(*KEY, "content")


@register
def redact_segments(spark, sf):
    """All patterns over texts that are cut at every line end."""
    edges = inputs.edge_texts(spark, sf).select("doc_id", "text").withColumn("ext", F.lit(""))
    options = OPTIONS.with_(enable_sanitizer=True)
    return segments.transform_segmented(edges, options, "text", size=1).drop("ext")


@register
def chain_segments(spark, sf):
    """A run's text steps, every text above 256 bytes in segments."""
    results = job.process(inputs.files(spark, sf, with_text=True), CHAIN, segment_bytes=256)
    return results.where("status = 'ok'").select(*KEY, "content", "n_tokens")


@register
def csv_list(spark, sf):
    listed = F.concat(F.lit(" ."), "lang", F.lit(" , ,"), "source", F.lit(",,\tx "), F.col("doc_id").cast("string"), F.lit(" "))
    rows = inputs.table(spark, sf, "documents").select("doc_id", text.csv_list(listed).alias("items"))
    return rows.select(
        "doc_id", F.size("items").cast("bigint").alias("n_items"), F.array_join("items", "|").alias("items")
    )


@register
def checksum(spark, sf):
    """Digests of the documents, checked against claimed ones."""
    docs = inputs.table(spark, sf, "documents")
    labels = inputs.table(spark, sf, "labels").select("doc_id", "quality")
    # Documents judged good carry their own digest, the others a wrong one.
    sums = docs.select("doc_id", text.checksum(F.col("text")).alias("sha256"), F.sha2("lang", 256).alias("wrong"))
    claimed = F.when(F.col("quality") == 1, F.upper("sha256")).when(F.col("quality") == 0, F.col("wrong"))
    return sums.join(labels, "doc_id", "left").select(
        "doc_id", "sha256", text.checksum_differs(F.col("sha256"), claimed).alias("differs")
    )


# -- Python code ------------------------------------------------------------

@register
def skeleton(spark, sf):
    outline = pycode.skeleton_where_python(F.col("content"), F.col("ext"))
    return _named(spark, sf, with_text=True).select(*KEY, outline.alias("content"))


@register
def symbols(spark, sf):
    rows = tree.symbol_rows(_in_tree(spark, sf))
    return rows.withColumn("ord", F.col("ord").cast("bigint"))


# -- trees ------------------------------------------------------------------

def _in_tree(spark: SparkSession, sf: str, options=OPTIONS) -> DataFrame:
    return filtering.scan(inputs.files(spark, sf, options.wants_symbols), options).where("in_tree")


@register
def tree_nodes(spark, sf):
    nodes = tree.tree_nodes(_in_tree(spark, sf))
    return nodes.withColumn("depth", F.col("depth").cast("bigint"))


@register
def tree_render(spark, sf):
    lines = tree.tree_lines(_in_tree(spark, sf))
    return lines.orderBy("project", "sort_key", "ord").select("project", "path", "line")


@register
def tree_symbols(spark, sf):
    options = OPTIONS.with_(show_functions=True, show_classes=True, show_methods=True)
    lines = tree.tree_lines(tree.with_symbols(_in_tree(spark, sf, options), options))
    return lines.orderBy("project", "sort_key", "ord").select(
        "project", "path", F.col("ord").cast("bigint").alias("ord"), "line"
    )


@register
def tree_line_counts(spark, sf):
    return tree.tree_line_counts(_in_tree(spark, sf))


# -- tokens and cost --------------------------------------------------------

@register
def tokens_heuristic(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    return docs.select("doc_id", tokens.heuristic_tokens(F.col("text")).alias("n_tokens"))


def _byte_encoder():
    """A vocabulary of single bytes: no merges, one token per UTF-8 byte."""
    import tiktoken

    return tiktoken.Encoding(
        "single-bytes", pat_str=r"[\s\S]", mergeable_ranks={bytes([b]): b for b in range(256)},
        special_tokens={},
    )


@register
def tokens_bpe(spark, sf):
    docs = inputs.texts(spark, sf, "doc_id", "text")
    return docs.select("doc_id", tokens.bpe_tokens(F.col("text"), _byte_encoder).alias("n_tokens"))


def _no_encoder():
    raise FileNotFoundError("no vocabulary here")


@register
def tokens_fallback(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    return docs.select("doc_id", tokens.bpe_tokens(F.col("text"), _no_encoder).alias("n_tokens"))


@register
def token_encoding(spark, sf):
    """Vocabulary by model name, over names made from the parts."""
    model = F.concat(
        F.when(F.col("p_size") % 4 == 0, "GPT-4-").when(F.col("p_size") % 4 == 1, "gpt-4o-")
        .when(F.col("p_size") % 4 == 2, "gpt-3.5-").otherwise("Legacy "), "p_name",
    )
    parts = inputs.table(spark, sf, "part").select("p_partkey", model.alias("model"))
    return parts.withColumn("encoding", tokens.encoding_name(F.col("model")))


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens per project, with the model each project is meant for."""
    docs = inputs.table(spark, sf, "documents")
    used = docs.groupBy(F.col("source").alias("project")).agg(
        F.sum(tokens.heuristic_tokens(F.col("text"))).alias("n_tokens")
    )
    return used.join(inputs.chosen_models(spark, sf), "project", "left")


@register
def tokens_by_project(spark, sf):
    return _usage(spark, sf).select("project", "n_tokens")


@register
def cost_by_model(spark, sf):
    priced = costing.with_cost(_usage(spark, sf), inputs.models(spark, sf))
    return priced.select("project", "target_model", "n_tokens", "cost_usd")


@register
def context_overflow(spark, sf):
    priced = costing.with_cost(_usage(spark, sf), inputs.models(spark, sf))
    return priced.select(
        "project", "n_tokens", F.col("context_limit").cast("bigint").alias("context_limit"), "over_limit"
    )


@register
def cost_cached(spark, sf):
    """Stored counts of labelled documents win over current counts."""
    docs = inputs.table(spark, sf, "documents")
    labels = inputs.table(spark, sf, "labels")
    counted = docs.select("doc_id", tokens.heuristic_tokens(F.col("text")).alias("current"))
    stored_count = (F.col("quality") * 1000 - F.col("toxic")).cast("bigint")
    rows = counted.join(labels, "doc_id", "left").select(
        "doc_id", costing.effective_tokens(F.col("current"), stored_count).alias("n_tokens")
    )
    return rows.withColumn("cost_usd", costing.cost(F.col("n_tokens"), F.lit(0.0025)))


# -- reuse ------------------------------------------------------------------

@register
def config_fingerprint(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    bit = lambda n: (F.col("n_chars") % (2 * n)) >= n
    depth = F.when(F.col("lang") == "en", "full").when(F.col("lang") == "fr", "skeleton").otherwise("tree_only")
    return docs.select(
        "doc_id",
        reuse.settings_fingerprint(depth, bit(1), bit(2), bit(4), bit(8), bit(16)).alias("config_hash"),
    )


@register
def file_fingerprint(spark, sf):
    files = inputs.files(spark, sf)
    full = reuse.with_fingerprint(files, OPTIONS).withColumnRenamed("fingerprint", "by_content")
    return reuse.with_fingerprint(full, OPTIONS, digest="stat").select(
        *KEY, "by_content", F.col("fingerprint").alias("by_stat")
    )


def _current(spark: SparkSession, sf: str) -> DataFrame:
    return reuse.with_fingerprint(inputs.files(spark, sf), OPTIONS)


@register
def cache_hits(spark, sf):
    found = reuse.hits(_current(spark, sf), inputs.earlier_results(spark, sf))
    return found.select(*KEY, "content", "n_tokens")


@register
def cache_misses(spark, sf):
    return reuse.misses(_current(spark, sf), inputs.earlier_results(spark, sf)).select(*KEY, "fingerprint")


@register
def cache_generations(spark, sf):
    """Hits in a cache that four runs wrote; the last one replaced results with odd counts."""
    cache = reuse.ResultCache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", buckets=8, merge_at=3)
    earlier = stored(inputs.earlier_results(spark, sf))
    run = F.pmod(F.crc32("fingerprint"), F.lit(3))
    for number in range(3):
        cache.append(earlier.where(run == number), OPTIONS)
    again = earlier.where("n_tokens % 2 = 1").withColumns({
        "content": F.concat(F.lit("again "), "content"), "created_at": F.col("created_at") + F.expr("interval 1 day"),
    })
    cache.append(again, OPTIONS)
    return reuse.hits(_current(spark, sf), cache.tables(OPTIONS)).select(*KEY, "content", "n_tokens")


@register
def shared_copies(spark, sf):
    """How many files hold the same text, told at each of them."""
    found = shared_text.with_copies(inputs.notes(spark, sf))
    return found.select(*KEY, F.col("_copies").cast("bigint").alias("copies"), F.col("_first").alias("is_first"))


@register
def shared_transform(spark, sf):
    """The whole chain, once for each text that several files have."""
    def change(df: DataFrame) -> DataFrame:
        return text.transform_column(df, CHAIN).withColumn("n_tokens", tokens.heuristic_tokens(F.col("content")))

    return shared_text.transform_once(inputs.notes(spark, sf), change, made=("content", "n_tokens")).drop("ext")


def _fresh(spark: SparkSession, sf: str) -> DataFrame:
    """New results of every file, stamped a second after the file's time."""
    return _current(spark, sf).select(
        "fingerprint", *KEY, F.concat(F.lit("fresh "), F.col("doc_id").cast("string")).alias("content"),
        F.col("n_chars").alias("n_tokens"),
        F.timestamp_micros(F.unix_micros("mtime") + 1_000_000).alias("created_at"),
    )


@register
def cache_upsert(spark, sf):
    merged = reuse.upsert(inputs.earlier_results(spark, sf), _fresh(spark, sf))
    return merged.select("fingerprint", *KEY, "content", "n_tokens")


@register
def cache_schema_evolve(spark, sf):
    """Rows from before token counts existed, with newer rows added."""
    old = inputs.earlier_results(spark, sf).drop("n_tokens")
    both = old.unionByName(_fresh(spark, sf), allowMissingColumns=True)
    return reuse.with_token_column(both).select("fingerprint", "content", "n_tokens")


# -- the model catalogue ----------------------------------------------------

MODEL = ["base_name", "id", "provider", "input_cost_1k", "output_cost_1k", "context_window"]


def _models(df: DataFrame) -> DataFrame:
    return df.select(*MODEL).withColumn("context_window", F.col("context_window").cast("bigint"))


@register
def registry_normalize(spark, sf):
    return _models(catalogue.normalize(inputs.catalogue_entries(spark, sf)))


@register
def registry_provider(spark, sf):
    rows = catalogue.normalize(inputs.catalogue_entries(spark, sf))
    return rows.groupBy("provider").agg(
        F.count("*").alias("n_models"), F.min("base_name").alias("first_model")
    )


@register
def registry_canonical(spark, sf):
    return _models(inputs.models(spark, sf))


@register
def registry_merge(spark, sf):
    live = catalogue.canonical(catalogue.normalize(inputs.live_entries(spark, sf)))
    return _models(catalogue.merge_live(inputs.models(spark, sf), live))


@register
def providers(spark, sf):
    return catalogue.providers(inputs.models(spark, sf))


@register
def models_by_provider(spark, sf):
    wanted = inputs.catalogue_entries(spark, sf).select(
        catalogue.provider_name(F.get_json_object("entry", "$.litellm_provider")).alias("provider")
    )
    brands = inputs.table(spark, sf, "part").select(F.upper("p_brand").alias("provider"))
    return catalogue.models_by_provider(inputs.models(spark, sf), wanted.unionByName(brands))


@register
def model_lookup(spark, sf):
    """Catalogue facts of the model chosen for each project, if known."""
    chosen = inputs.chosen_models(spark, sf)
    found = costing.with_model(chosen, inputs.models(spark, sf))
    return found.select(
        "project", "target_model", "input_cost_1k", F.col("context_limit").cast("bigint").alias("context_limit")
    )


# -- counters ---------------------------------------------------------------

STRICT = OPTIONS.with_(process_tests=False)


def _results(spark: SparkSession, sf: str, options=STRICT) -> DataFrame:
    return job.process(inputs.files(spark, sf), options, inputs.earlier_results(spark, sf, options))


@register
def run_counters(spark, sf):
    return counters.run_counters(_results(spark, sf))


@register
def target_counts(spark, sf):
    return counters.target_counts(_results(spark, sf, OPTIONS))


@register
def run_summary(spark, sf):
    return _written(spark, sf).summary().select(
        "project", "processed", "skipped", "errors", "token_count", "tree_lines",
        F.array_join("generated", ",").alias("generated"),
    )


@register
def summary_json(spark, sf):
    rows = counters.run_counters(job.process(inputs.files(spark, sf), STRICT))
    return counters.summary_json(rows)


# -- documents --------------------------------------------------------------

BLOCK = ["project", "section", "sort_key", "ord", "value"]


def _blocks(df: DataFrame) -> DataFrame:
    wide = df.withColumn("section", F.col("section").cast("bigint")).withColumn("ord", F.col("ord").cast("bigint"))
    return assembly.ordered(wide.select(*BLOCK))


def _written(spark: SparkSession, sf: str) -> job.Job:
    """Results on disk, as in a run: transformed once, then read column by column."""
    return job.Job(stored(job.process(inputs.files(spark, sf), OPTIONS)), OPTIONS)


@register
def entry_block(spark, sf):
    written = job.Job(job.process(inputs.files(spark, sf), OPTIONS), OPTIONS).written
    return written.select(*KEY, assembly.entry_block(F.col("rel_path"), F.col("content")).alias("block"))


@register
def category_docs(spark, sf):
    return _blocks(_written(spark, sf).categories)


@register
def unified_doc(spark, sf):
    return _blocks(_written(spark, sf).unified)


@register
def document_tokens(spark, sf):
    return assembly.document_tokens(_written(spark, sf).sizes)


@register
def document_map(spark, sf):
    """Offset and line range of every block of the unified documents."""
    return _written(spark, sf).map.withColumns({c: F.col(c).cast("bigint") for c in ("section", "ord")})


@register
def symbol_document_map(spark, sf):
    """The same for documents whose trees list functions, classes and methods."""
    options = OPTIONS.with_(show_functions=True, show_classes=True, show_methods=True)
    whole = job.Job(stored(job.process(inputs.files(spark, sf), options)), options)
    ends = whole.map.groupBy("project", "section").agg(
        F.count("*").alias("n_blocks"), F.min("start").alias("start"),
        F.max(F.col("start") + F.col("n_chars")).alias("stop"),
        F.min("first_line").alias("first_line"), F.sum("n_lines").alias("n_lines"),
    )
    return ends.withColumn("section", F.col("section").cast("bigint"))


@register
def conversation_context(spark, sf):
    turns = inputs.conversation_files(spark, sf)
    return _blocks(assembly.unified_blocks(turns.select("project").distinct(), turns))


@register
def error_report(spark, sf):
    """Files the scan admits but the router turns away, as a report."""
    strict = OPTIONS.with_(process_tests=False)
    failed = job.Job(job.process(inputs.files(spark, sf), strict), strict).errors
    return _blocks(assembly.error_blocks(failed))


# -- all of it --------------------------------------------------------------

@register
def context_price(spark, sf):
    """Redact, minify, count and price every document, per project and language."""
    docs = inputs.texts(spark, sf, "source", "lang", "text")
    clean = text.redact_column(docs, "text").withColumn("text", text.minify(F.col("text"), F.lit(".md")))
    used = clean.groupBy(F.col("source").alias("project"), "lang").agg(
        F.count("*").alias("n_files"), F.sum(tokens.heuristic_tokens(F.col("text"))).alias("n_tokens")
    )
    priced = costing.with_cost(
        used.join(inputs.chosen_models(spark, sf), "project", "left"), inputs.models(spark, sf)
    )
    return priced.select("project", "lang", "n_files", "n_tokens", "target_model", "cost_usd", "over_limit")
