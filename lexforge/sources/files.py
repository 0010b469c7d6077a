"""Readers of document collections, and a registry of them by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str | list[str], schema: str = "text STRING", keep_bad: bool = False, glob: str | None = None) -> DataFrame:
    """JSON lines of a file, folder or list (also .gz and .bz2) with ``file``, the name of each row's file.

    Lines that are no JSON object are dropped, or kept in ``_corrupt_record``. Extra keys are dropped unless in ``schema``.
    """
    reader = spark.read.option("mode", "PERMISSIVE" if keep_bad else "DROPMALFORMED").schema(schema + (", _corrupt_record STRING" if keep_bad else ""))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path).select("*", F.col("_metadata.file_name").alias("file"))


def raw_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value (the line as it is), text, and ``extra``: all other keys as a map of strings; lines that are no object have a null text."""
    d = spark.read.text(path)
    every = F.from_json("value", "map<string,string>")
    return d.select("value", F.element_at(every, "text").alias("text"), F.map_filter(every, lambda k, _: k != "text").alias("extra"))


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text of the articles of a MediaWiki XML dump: namespace 0, no redirect; the first revision that has text."""
    schema = "id LONG, title STRING, ns INT, redirect STRUCT<_title: STRING>, revision ARRAY<STRUCT<text: STRING>>"
    d = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", "true").schema(schema).load(path)
    texts = F.filter(F.transform("revision", lambda r: r["text"]), lambda x: F.coalesce(F.length(x), F.lit(0)) > 0)
    return d.where("ns = 0 and redirect is null").select("id", "title", F.get(texts, F.lit(0)).alias("text"))


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url: the lines of a text file that are not empty."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


READERS: dict[str, Callable[..., DataFrame]] = {"jsonl": jsonl, "raw_jsonl": raw_jsonl, "wiki_dump": wiki_dump, "parquet": parquet, "url_list": url_list}


def read(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    if name not in READERS:
        raise ValueError(f"no reader {name!r}; there are {', '.join(READERS)}")
    return READERS[name](spark, *args, **options)
