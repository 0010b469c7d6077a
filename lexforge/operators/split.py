"""Splits, samples and orders that depend on a seed and keys only: neither on partitions nor on reruns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..shared import running


def uniform(seed: int, key: Column) -> Column:
    """A number from 0 to 1 for each key."""
    return t.hash32(F.concat(F.lit(f"{seed}:"), key.cast("string"))) / F.lit(float(1 << 32))


def bernoulli(docs: DataFrame, rate: float = 0.9, seed: int = 1234, key: str = "doc_id") -> DataFrame:
    """Non-empty documents with ``part``: 'encrypt' at ``rate``, else 'plain'."""
    return docs.where(t.nonempty(F.col("text"))).withColumn("part", F.when(uniform(seed, F.col(key)) < rate, "encrypt").otherwise("plain"))


def seeded_key(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def sample_exact(df: DataFrame, n: int, seed: int = 1234, key: str = "doc_id") -> DataFrame:
    """Exactly ``n`` rows: the smallest seeded hashes (each task keeps n). Fewer rows than n are an error."""
    some = df.orderBy(seeded_key(seed, key), key).limit(n)
    if (have := some.count()) < n:
        raise ValueError(f"a sample of {n} from {have} rows")
    return some


def shuffled(df: DataFrame, seed: int = 1234, key: str = "doc_id") -> DataFrame:
    """``df`` with ``position``, its place in a seeded order."""
    return running(df.withColumn("_key", seeded_key(seed, key)), [F.col("_key"), F.col(key)], name="position").drop("_key")


def bounds(n: int, shares: tuple[int, ...] = (949, 50, 1)) -> list[int]:
    """Where the ranges of ``n`` documents end."""
    total, ends, cum = sum(shares), [], 0
    for s in shares:
        cum += s
        ends.append(int(n * cum / total + 0.5))
    return ends


def by_ranges(df: DataFrame, order: str = "doc_id", shares: tuple[int, ...] = (949, 50, 1), names: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """``df`` with ``split``: contiguous ranges in the order of a column."""
    ranked = running(df, [F.col(order)], name="rank")
    ends = bounds(df.count(), shares)
    split = reduce(lambda c, x: c.when(F.col("rank") < x[0], x[1]), zip(ends, names, strict=True), F.when(F.lit(False), ""))
    return ranked.withColumn("split", split)


def merged(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts; columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
