"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bound_batches

#: A run of these characters is a word in most contracts; the bytes are those of ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder; any other gets a folder in the warehouse.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        global _own
        if not _own:
            _own = tempfile.mkdtemp(prefix="lexforge-")
            atexit.register(lambda: __import__("shutil").rmtree(_own, ignore_errors=True))
        return f"file://{_own}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


_own = ""


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    bound_batches(spark)
    path = f"{shared_dir(spark)}/lexforge/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended first; a leftover folder does no harm
        pass


#: Whether the shuffle files of a query go when it ends, rather than when the driver next collects garbage: what is written needs none.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of a side that is broadcast, as its columns take them (some three times that as a hash table).
SMALL = 16 << 20


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted and measured in place by one aggregate, take few bytes; else as it is, to be
    joined by shuffle. Pass what ``cut`` has written: it is read for this."""
    width, sizes = 16, []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        width += 8
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif kind == "array":
            sizes.append(32 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)))
    each = sum(sizes, F.lit(width)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= most else df


def crc_mod(doc_id, n: int):
    """crc32(doc_id as text) mod n, natively; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: What operators keep in a worker between their tasks; tasks of others drop it.
kept: dict[str, dict] = {}


def forget(but: str) -> None:
    """Drops what is kept, but for one entry. A function of the module, so that it meets the worker's own ``kept``."""
    for name in kept:
        if name != but:
            kept[name].clear()


def tidy(run, keep: str = ""):
    """``run``, a function of Arrow batches, that gives its worker's free memory back to the system when it ends.

    ``keep`` names the one entry of ``kept`` that it uses; it drops what other operators left in the worker.
    """

    def go(batches):
        forget(keep)
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return go


# ---- vectorised word hashing for the Arrow operators -------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.ones(1, np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        new = np.full(max(n, 1024), _R, np.uint64)
        new[0] = 1
        _POWER = np.multiply.accumulate(new)
    return _POWER


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, and the n + 1 offsets; nulls are empty."""
    import pyarrow as pa

    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts (A-Z lower-cased), and the n + 1 word offsets by text.

    ``raw`` and ``at`` are as ``buffer`` gives them. Memory is some 40 bytes for each byte of text, so
    callers go through their batches in pieces.
    """
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = ~space
    inner = first.copy()
    first[1:] &= space[:-1]
    edge = at[:-1]
    edge = edge[edge < len(raw)]
    first[edge] = inner[edge]  # the first byte of a text begins a word although the byte before it is none
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    letters = _LOWER[raw[inner]]
    begin = (np.cumsum(inner) - 1)[starts]
    lengths = np.diff(np.append(begin, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    h = np.add.reduceat(_BYTE[letters] * _powers(int(lengths.max()))[place], begin)
    return mix(h ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), counts


def pieces(at: np.ndarray, most: int = 1 << 22):
    """Ranges of texts of about ``most`` bytes each; one text is never split."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j
