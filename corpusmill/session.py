"""A Spark session with the settings this library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A union that claims its children's partitioning can split a key over tasks.
    "spark.sql.unionOutputPartitioning": "false",
    # Rows are whole files, so a read split of 64 MB is already plenty of work.
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def local_session(cpus: int = 8, name: str = "corpusmill", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
