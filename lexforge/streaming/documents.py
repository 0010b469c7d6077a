"""Streams of documents: filters, ciphers and statistics on files as they arrive, and first-seen copies.

Filters and ciphers have no state. Copies are told by the digest of the text; state is a digest for each text of the
watermark's span, kept by Spark, so it does not grow without bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cipher
from ..functions import text as t
from ..operators.filters import Chain


def read_jsonl(spark: SparkSession, path: str, schema: str = "doc_id LONG, text STRING, source STRING, ts TIMESTAMP", files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def filtered(stream: DataFrame, chain: Chain) -> DataFrame:
    return chain.apply(stream)


def enciphered(stream: DataFrame, key_length: int = 0, seed: int = 1234) -> DataFrame:
    return stream.where(t.nonempty(F.col("text"))).withColumn("text", cipher.poly(F.col("text"), key_length, seed))


def first_seen(stream: DataFrame, time: str = "ts", span: str = "1 hour") -> DataFrame:
    """The first document of each text within ``span``."""
    return stream.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark(time, span).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def counts(stream: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Documents and characters by window and source; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))
