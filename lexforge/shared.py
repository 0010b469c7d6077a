"""Sessions, tables, the shared folder, and ranks over a whole table without a single task that sees it all."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine; on a cluster, sessions come from spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Most bytes of an Arrow batch, where the session says nothing: it is held by the executor and by the Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Rows of a batch are bounded by number anyway; long texts make this the bound that counts. A value that a user set stays."""
    if spark.conf.get(BATCH[0], None) in (None, "67108864", "67108864b", "64m"):
        spark.conf.set(BATCH[0], str(BATCH[1]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own = ""


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where that is unset, a local master gets a temporary one."""
    global _own
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top and (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        if not _own:
            _own = tempfile.mkdtemp(prefix="lexforge-")
            atexit.register(shutil.rmtree, _own, True)
        top = f"file://{_own}"
    top = top or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    path = f"{top.rstrip('/')}/lexforge/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """What was written for one session goes with its driver."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended first
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most keys that ``join_heads`` broadcasts.
HEADS = 4096


def join_heads(left: DataFrame, right: DataFrame, on: list[str], n: str, rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key, and in ``n`` how many of the ``rows`` rows of ``left`` have it.

    Keys of more than rows / HEADS rows are fewer than HEADS, so they are broadcast, and their rows stay where they are; all others
    are joined by shuffle, where no key can fill a task. ``left`` is read twice: pass a table.
    """
    hot = F.col(n) > max(1, rows // HEADS)
    more = [c for c in right.columns if c not in on]
    marked = left.join(F.broadcast(right.where(hot).withColumn("_head", F.lit(True))), on, "left")
    rest = marked.where("_head is null").drop("_head", *more).join(right.where(~hot), on, how)
    return marked.where("_head").drop("_head").unionByName(rest)


def carried(d: DataFrame, amount: str, name: str) -> DataFrame:
    """``d``, whose ``name`` counts from the start of the row's ``_part``, with what all parts before hold of ``amount`` added. Pass a table."""
    sums = d.groupBy("_part").agg(F.sum(amount).alias("_sum"))  # one row a partition
    first = sums.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return d.join(F.broadcast(first), "_part").withColumn(name, (F.col(name) + F.col("_first")).cast("long")).drop("_first")


def running(df: DataFrame, order: list[Column], amount: Column | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``amount`` (1 if not given: the row's rank from 0) over all rows before each, in ``order``.

    Rows are dealt by ranges of ``order`` (one shuffle; pass narrow rows) and summed in their partition; a table of one row per partition holds what the
    partitions before hold. Nothing goes through one task. End ``order`` with a key, so that
    reruns agree.
    """
    columns = df.columns
    amount = F.lit(1).cast("long") if amount is None else amount.cast("long")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = df.withColumn("_amount", amount).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def run(batches):
        total = 0
        for batch in batches:
            sums = np.cumsum(batch.column("_amount").fill_null(0).to_numpy())
            before = np.concatenate([[0], sums[:-1]]) + total if len(sums) else sums
            total += int(sums[-1]) if len(sums) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before.astype(np.int64))], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    d = cut(d.mapInArrow(run, f"{kinds}, `{name}` long"), "running")
    return carried(d, "_amount", name).select(*columns, name)
