"""Lists of files to read: numbered shards, filtered URL lists, expanded templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shards of each split.
SPLITS = {"train": 1024, "validation": 8}


def shards(spark: SparkSession, split: str, first: int, end: int) -> DataFrame:
    """shard, name of the shards ``first`` to ``end`` - 1 of a split."""
    if split not in SPLITS:
        raise ValueError(f"no split {split!r}; there are {', '.join(SPLITS)}")
    if not 0 <= first <= end <= SPLITS[split]:
        raise ValueError(f"shards {first} to {end} of {SPLITS[split]}")
    return spark.range(first, end).select(F.col("id").alias("shard"), F.format_string(f"{split}/part.%05d-of-{SPLITS[split]:05d}.json.gz", "id").alias("name"))


def key(url: Column) -> Column:
    """A URL without scheme and host."""
    return F.regexp_replace(url, "^https?://[^/]+/", "")


def wanted(manifest: DataFrame, url: str, split: str | None = None, have: DataFrame | None = None) -> DataFrame:
    """``manifest`` with ``key``: rows of a split whose key isn't in ``have`` (key) already."""
    d = manifest.withColumn("key", key(F.col(url)))
    if split:
        d = d.where(F.col("key").startswith(f"{split}/"))
    return d.join(have, "key", "left_anti") if have is not None else d


def expanded(spark: SparkSession, langs: list[str], snapshots: list[str], parts: list[str], n: int) -> DataFrame:
    """lang, snapshot, part, name of all shards of all snapshots."""
    every = lambda x: F.explode(F.array(*map(F.lit, x)))
    d = spark.range(n).select("id", every(langs).alias("lang")).select("*", every(snapshots).alias("snapshot")).select("*", every(parts).alias("part"))
    return d.select("lang", "snapshot", "part", F.format_string("documents/%s/%04d/%s_%s.json.gz", "snapshot", "id", "lang", "part").alias("name"))
