"""Op 4, quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of neighbouring words fall into ``BUCKETS`` hashed buckets. The raw multinomial counts them in all
documents, the target one in those that the labels call good. A document's score is the mean, over its words and
pairs, of log p_target / p_raw, so it doesn't grow with length; at ``THRESHOLD`` or more it passes. The first rules
(few words, many repeated ones) come before.

Two passes over the texts: counts (aggregated by bucket before the shuffle), then scores (no shuffle; the weights are a
scalar subquery of BUCKETS numbers). Everything is DataFrame functions.

Defined results: a null text has no words; it and other short texts fail the first rules and have a score of 0 where
nothing can be scored. Without trusted documents all scores are 0 and the verdict is theirs. Labels of null or unknown
documents count for nothing; a document that one of several labels calls good is good. Repeated rows count each and
have a row each. A score that equals the threshold keeps the document. A very long text is scored whole. An empty table has an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, small, table

BUCKETS = 10_000
#: Score from which on a document passes, in nats a word or pair.
THRESHOLD = -0.15
MIN_WORDS = 10
WINDOW = 5


def _hashes(docs: DataFrame, keep: list) -> DataFrame:
    """``keep`` with words, n, h (hashes of words) and b (of pairs)."""
    d = docs.select(*keep, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    d = d.select("*", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    pairs = F.greatest(F.col("n") - 1, F.lit(0))
    return d.select("*", F.zip_with(F.slice("h", F.lit(1), pairs), F.slice("h", F.lit(2), pairs), lambda x, y: F.xxhash64(x, y)).alias("b"))


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, alpha: float = 1.0) -> DataFrame:
    """One row: the log ratios of all buckets, as an array."""
    good = labels.where("quality > 0 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(1))
    rows = _hashes(docs.join(small(good), "doc_id", "left"), ["good"])
    counts = rows.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(F.concat("h", "b")).alias("g")).groupBy(F.pmod("g", F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    # at most ``buckets`` rows
    total = every.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"))
    size = F.lit(alpha * buckets)
    share = lambda c, n: F.log((c + F.lit(alpha)) / (n + size))
    ratio = F.transform("all", lambda x: F.when(F.col("target") > 0, share(x["target"], F.col("target")) - share(x["raw"], F.col("raw"))).otherwise(F.lit(0.0)))
    return total.select(ratio.cast("array<float>").alias("w"))


def _repeated(d: DataFrame) -> DataFrame:
    """Adds n_repeat: words in windows that occur twice or more. Hashes say where there are none; else the words decide."""
    n = lambda k: F.greatest(F.col("n") - k, F.lit(0))
    d = d.withColumn("q", F.zip_with(F.slice("b", F.lit(1), n(3)), F.slice("b", F.lit(3), n(3)), lambda x, y: F.xxhash64(x, y)))
    d = d.withColumn("q", F.zip_with(F.slice("q", F.lit(1), n(4)), F.slice("h", F.lit(5), n(4)), lambda x, y: F.xxhash64(x, y)))
    texts = F.transform(F.sequence(F.lit(1), F.col("n") - 4), lambda i: F.struct(F.array_join(F.slice("words", i, F.lit(WINDOW)), " ").alias("t"), i.alias("i")))
    d = d.withColumn("s", F.when((F.col("n") > WINDOW) & (F.size(F.array_distinct("q")) < F.size("q")), F.sort_array(texts))).drop("words", "q")
    twice = F.filter("s", lambda x, j: (x["t"] == F.get("s", j - 1)["t"]) | (x["t"] == F.get("s", j + 1)["t"]))
    d = d.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    steps = F.transform("at", lambda p, j: F.coalesce(F.least(F.get("at", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return d.withColumn("n_repeat", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("at")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return lines


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the base counts, base_failed, kept and the score ``llr``."""
    text = F.coalesce("text", F.lit(""))
    first = docs.select(
        "doc_id", "text", _dup_lines(text).alias("lines"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols")
    )
    d = _hashes(first.select("doc_id", "text", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")), ["doc_id", "n_symbols", "n_dup_lines"])
    d = d.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    add = lambda a, x: a + F.get("w", F.pmod(x, F.lit(BUCKETS)).cast("int"))
    d = d.withColumn("w", weights(docs, labels).scalar()).withColumn("sum", F.aggregate("b", F.aggregate("h", F.lit(0.0), add), add)).drop("w")
    d = _repeated(d)
    grams = F.col("n") + F.greatest(F.col("n") - 1, F.lit(0))
    d = d.withColumn("llr", F.when(F.col("n") > 0, F.col("sum") / grams).otherwise(F.lit(0.0)))
    failed = (F.col("n") < MIN_WORDS) | (100 * F.col("n_repeat") > 20 * F.col("n"))
    return d.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("n_repeat").alias("n_repeat_words"), failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")


def op4_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
