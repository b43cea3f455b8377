"""A corpus, from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)``; its rows are written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns
of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import language_id, line_dedup, mixing, near_dedup, packing
from corpusmill.scale import shared_dir, small_side

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this cosine with every language a text is no language's.
MIN_SCORE = 0.05


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` as the text now is."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with ``lang`` as it was found.

    Rejected are texts without a letter and those unlike every language.
    """
    model = language_id.learn(docs.where(language_id.fold("doc_id") != 0))
    found = language_id.predict(docs, model, carry=("text", "source"))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return _as_documents(found.where(known).withColumnRenamed("lang_pred", "lang"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that earlier documents hold.

    A document of which no word is left goes.
    """
    return _as_documents(line_dedup.drop_repeated_lines(docs).where(~F.col("emptied")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies on five-word shingles: the least id.

    Of rows that repeat an id, those of one text stay once.
    """
    groups = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    gone, _ = small_side(groups.where("not kept").select("doc_id").distinct())
    again, _ = small_side(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    docs = docs.join(gone, "doc_id", "left_anti")
    once = docs.join(again, "doc_id", "left_anti")
    return _as_documents(once.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture; a document that is taken twice is there twice."""
    mixed = mixing.fair_mix(docs, keep_text=True).where("n_copies > 0")
    return _as_documents(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Hashes of words and learned vectors have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's rows stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
