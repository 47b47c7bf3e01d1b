"""Incremental ingest of record files: normalisation as a stream that stops when it has caught up."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from erspark.functions import names
from erspark.sources.scans import RECORD


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Appends the normalised records of new tab-separated files to a Parquet folder, each file exactly once."""
    raw = spark.readStream.schema(RECORD).option("sep", "\t").option("quote", "").option("header", True).csv(source)
    name = names.clean(F.col("business_name"))
    core, suffix = names.strip_suffix(name)
    out = raw.select("entity_id", name.alias("name_clean"), names.clean(F.col("business_address")).alias("addr_clean"), core.alias("name_core"), suffix.alias("name_suffix"), F.coalesce("country", F.lit("")).alias("country"))
    out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
