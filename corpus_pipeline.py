"""A training corpus from ``documents``: toxicity, near-duplicates, secrets, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the next
stage's documents. All but the last return the columns of ``docs``. The pipeline as a whole has no SQL (the
classifier, hashes and packing are none of SQL's). ``tests/llm`` computes in plain Python which documents and texts reach the
mix, and holds ``run``'s pieces against them, the tokenizer and the targets; only which documents the mix draws is read from the result.

Defined results: an empty table gives an empty result; extra columns are carried along to the last stage; null texts have no
words, so that mixing leaves them out; of equal rows one stays; ties go to the smallest doc_id; very long texts pass whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.bottom_k import near_duplicates
from lexforge.llm.common import cut, scratch_path, small, table
from lexforge.llm.mixing import mixed
from lexforge.llm.packing import packed
from lexforge.llm.secrets import redacted
from lexforge.llm.toxicity import THRESHOLD, fit, scores

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold; the classifier learns from the labels of those that are in ``docs``."""
    weights, constant = fit(docs, table(spark, sf_dir, "labels"))
    return scores(docs, weights, constant, docs.columns, "_toxicity").where(F.col("_toxicity") < THRESHOLD).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id; of rows that are the same, one."""
    found = cut(near_duplicates(docs, SHINGLE).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kept"), "pipeline-near")
    same = lambda d, x: d.doc_id.eqNullSafe(x._id) & (F.xxhash64(d.text) == x._hash)
    gone = small(cut(found.where("not kept").select("_id", "_hash").distinct(), "pipeline-gone"))
    left = docs.join(gone, same(docs, gone), "left_anti")
    twice = cut(found.where("kept").groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "pipeline-twice")
    if not twice.limit(1).count():
        return left
    twice = small(twice)
    one = left.join(twice, same(left, twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same(left, twice), "left_anti").unionByName(one).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; the last one of a source may be cut."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packed(docs.select("doc_id", "text"), ["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
