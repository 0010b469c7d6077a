"""Sentences that name persons, how often each is named, and test sets made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cipher
from ..functions import text as t
from .split import seeded_key


def rule_entities(sentence: Column) -> Column:
    """Mail names, phone and card numbers, where no recogniser of names is given."""
    return F.regexp_extract_all(sentence, F.lit(t.ENTITY), F.lit(0))


def privacy_sentences(docs: DataFrame, entities: Callable[[Column], Column] = rule_entities) -> DataFrame:
    """doc_id, pos (of the sentence in the document), text, persons: sentences that end with a full stop and name someone."""
    s = docs.select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "text"))
    return s.withColumn("persons", entities(F.col("text"))).where(F.size("persons") > 0)


def person_frequency(found: DataFrame) -> DataFrame:
    return found.select(F.explode("persons").alias("person")).groupBy("person").agg(F.count(F.lit(1)).alias("n"))


def first_sentences(found: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` in document order; each task keeps n."""
    return found.orderBy("doc_id", "pos").limit(n)


def test_set(found: DataFrame, n: int = 1000, keys: tuple[int, ...] = (1, 100, 10_000, 0), seed: int = 1234) -> DataFrame:
    """item, key_length (null: plain), text: at most ``n`` sentences drawn by the seed, plain and under each key."""
    some = found.withColumn("item", F.concat_ws("-", "doc_id", "pos")).orderBy(seeded_key(seed, "item"), "item").limit(n)
    every = F.array(F.struct(F.lit(None).cast("int").alias("key_length"), F.col("text")), *[F.struct(F.lit(k).alias("key_length"), cipher.poly(F.col("text"), k, seed).alias("text")) for k in keys])
    return some.select("item", F.explode(every).alias("v")).select("item", "v.*")
