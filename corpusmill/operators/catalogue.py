"""The model catalogue: raw entries in, one priced model per base name out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv

# FIXED VALUES: field names of the public catalogue format.
ENTRY_SCHEMA = (
    "mode string, litellm_provider string, max_input_tokens double, max_tokens double, "
    "input_cost_per_token double, output_cost_per_token double"
)
MODEL_SCHEMA = (
    "base_name string, id string, provider string, input_cost_1k double, "
    "output_cost_1k double, context_window int"
)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a catalogue file: ``(seq, model_id, entry)`` in file order.

    The file is one JSON object, ``{model id: {...}, ...}``.
    """
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,string>")
    return whole.select(F.posexplode(entries).alias("seq", "model_id", "entry"))


def first_available(
    spark: SparkSession, curated_path: str | None, snapshot_path: str | None
) -> DataFrame:
    """Models from the first tier that has any: curated table, snapshot, none."""
    for path, read in (
        (curated_path, spark.read.parquet),
        (snapshot_path, lambda p: canonical(normalize(read_snapshot(spark, p)))),
    ):
        if not path:
            continue
        try:
            models = read(path)
            if not models.isEmpty():
                return models
        except AnalysisException as problem:
            # Only a tier that is not there is passed over; a broken one shows.
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], MODEL_SCHEMA)


def provider_name(raw: Column) -> Column:
    """Consolidated provider; names the table does not know pass in capitals."""
    known = F.create_map(*[F.lit(x) for pair in fv.PROVIDER_NAMES.items() for x in pair])
    upper = F.upper(F.coalesce(raw, F.lit(fv.UNKNOWN_PROVIDER)))
    return F.coalesce(F.try_element_at(known, upper), upper)


def is_infrastructure(provider: Column) -> Column:
    hit = F.lit(False)
    for mark in fv.INFRASTRUCTURE_MARKS:
        hit = hit | F.contains(provider, F.lit(mark))
    return hit


def normalize(entries: DataFrame) -> DataFrame:
    """Text models only, with prices per 1000 tokens and a context window.

    Drops the template entry, values that are not objects and other modes.
    """
    e = F.col("e")
    window = F.coalesce(
        F.nullif(e["max_input_tokens"], F.lit(0.0)),
        F.nullif(e["max_tokens"], F.lit(0.0)),
        F.lit(float(fv.DEFAULT_CONTEXT_WINDOW)),
    )
    return (
        entries.where(F.col("model_id") != fv.CATALOGUE_TEMPLATE_ID)
        .withColumn("e", F.from_json("entry", ENTRY_SCHEMA))
        .where(F.lower(e["mode"]).isin(*fv.TEXT_MODES))
        .select(
            "seq",
            F.substring_index("model_id", "/", -1).alias("base_name"),
            F.col("model_id").alias("id"),
            provider_name(e["litellm_provider"]).alias("provider"),
            (F.coalesce(e["input_cost_per_token"], F.lit(0.0)) * 1000).alias("input_cost_1k"),
            (F.coalesce(e["output_cost_per_token"], F.lit(0.0)) * 1000).alias("output_cost_1k"),
            window.cast("int").alias("context_window"),
        )
    )


def canonical(models: DataFrame) -> DataFrame:
    """One model per base name: the first that is not infrastructure, else the first.

    Partial minima run before the shuffle, so a base name with very many
    variants costs no more than any other.
    """
    rank = F.struct(is_infrastructure(F.col("provider")), F.col("seq"))
    kept = F.struct("id", "provider", "input_cost_1k", "output_cost_1k", "context_window")
    return (
        models.groupBy("base_name").agg(F.min_by(kept, rank).alias("m")).select("base_name", "m.*")
    )


def merge_live(cached: DataFrame, live: DataFrame) -> DataFrame:
    """Live models replace cached ones of the same base name."""
    rest = cached.join(live.select("base_name"), "base_name", "left_anti")
    return live.unionByName(rest)


def providers(models: DataFrame) -> DataFrame:
    return models.select("provider").distinct().orderBy("provider")


def models_by_provider(models: DataFrame, wanted: DataFrame) -> DataFrame:
    """Model names of each wanted provider in order, one row each.

    A provider without models gets one placeholder row.  Rows rather than
    lists, because one provider may own a large share of the catalogue.
    """
    named = models.select("provider", F.col("base_name").alias("model"))
    empty = (
        wanted.select("provider").distinct()
        .join(named.select("provider").distinct(), "provider", "left_anti")
        .withColumn("model", F.lit(fv.NO_MODELS))
    )
    return named.unionByName(empty).orderBy("provider", "model")
