"""Writers. Each is one distributed write; a merged file is asked for by name, as it goes through one task."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cipher
from ..functions import text as t


def accepted_and_rejected(applied: DataFrame, path: str, by: str | None = None) -> None:
    """What a chain gave, as JSON in is_rejected=false and is_rejected=true (with reasons), in one pass; by file or source if asked for."""
    applied.write.mode("overwrite").partitionBy("is_rejected", *([by] if by else [])).json(path)


def statistics(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)  # one row a source


def merged(df: DataFrame, path: str, parts: int = 1) -> None:
    """JSON lines in ``parts`` files."""
    df.repartition(parts).write.mode("overwrite").json(path)


def sharded(df: DataFrame, path: str, key: str, shards: int = 100) -> None:
    """JSON by shard=N, the SHA-256 of a column mod N. Rows move once; a shard is spread over tasks by a second hash."""
    d = df.withColumn("shard", t.sha256_mod(F.col(key), shards))
    spread = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    d.repartition("shard", F.pmod(F.xxhash64(key), F.lit(spread))).write.mode("overwrite").partitionBy("shard").json(path)


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t")


def nonempty_jsonl(df: DataFrame, path: str) -> None:
    df.where(t.nonempty(F.col("text"))).write.mode("overwrite").json(path)


def tokens(df: DataFrame, path: str) -> None:
    """Token ids as Parquet; what is there already stays."""
    df.write.mode("ignore").parquet(path)


def enciphered_jsonl(spark: SparkSession, source: str, path: str, name: str = "poly", seed: int = 1234, key_length: int = 0) -> None:
    """JSON lines with their text enciphered, all other keys and their order as they were; lines without a text are left out.

    The line's object keeps its keys as they are written: only the text's value is replaced, in one pass without a shuffle.
    """
    d = spark.read.text(source).select("value", F.get_json_object("value", "$.text").alias("text")).where("text is not null")
    d = d.withColumn("text", cipher.encipher(name, F.col("text"), seed, key_length))

    @F.arrow_udf("string")
    def put(lines: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([json.dumps({**json.loads(x), "text": t}, ensure_ascii=False) for x, t in zip(lines.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    d.select(put("value", "text").alias("value")).write.mode("overwrite").text(path)
