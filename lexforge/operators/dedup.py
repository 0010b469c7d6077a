"""Copies: exact ones, and near ones by MinHash bands, the first seen wins.

A signature's values are minima of affine maps of one md5-based 32-bit hash of each shingle; a band is the md5 of its values.
A document is rejected if any of its bands was seen in a document with a smaller id; bands of rejected documents count as
seen. So no iteration is needed: of each band the smallest id, then one comparison.
"""

from __future__ import annotations

import random
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..shared import cut, join_heads

PRIME = 4_294_967_311
SHINGLE, PERMUTATIONS, ROWS = 5, 64, 8


def coefficients(n: int = PERMUTATIONS, seed: int = 1) -> list[tuple[int, int]]:
    """Of the affine maps; small enough for 64-bit products."""
    r = random.Random(seed)
    return [(r.randrange(1, 1 << 30), r.randrange(1 << 30)) for _ in range(n)]


def _minima(lists: pa.Array, width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of each list of words, or -1 where it has none: one row for each list."""
    out, prime = np.full((len(lists), len(a)), -1, np.int64), np.uint64(PRIME)
    for row, words in enumerate(lists):
        if not words.is_valid or not len(words.values):
            continue
        raw = " ".join(words.values.to_pylist()).encode()
        ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw))  # no word holds a blank
        first, last = np.concatenate([[0], ends[:-1] + 1]).tolist(), ends[min(width, len(ends)) - 1 :].tolist()
        h = np.frombuffer(b"".join([md5(raw[x:y]).digest()[:4] for x, y in zip(first, last, strict=False)]), ">u4").astype(np.uint64)
        least = out[row]
        for k in range(0, len(h), 256):  # 256 hashes under all maps fit a core's cache
            x = h[k : k + 256] * a[:, None] + b[:, None]
            x -= x // prime * prime  # NumPy divides by one number faster than it takes remainders
            low = x.min(axis=1).astype(np.int64)
            least[:] = np.minimum(least, low) if k else low
    return out


def signatures(docs: DataFrame, keep: list[str], width: int = SHINGLE, n: int = PERMUTATIONS) -> DataFrame:
    """``keep`` (they identify a row) and sig, an array of ``n`` minima, of documents that have words. A document's shingles are hashed and
    reduced where it is; rows that ``keep`` does not tell apart are merged."""
    a, b = (np.array(x, np.uint64) for x in zip(*coefficients(n), strict=True))

    def run(batches):
        for batch in batches:
            low = _minima(batch.column("_words"), width, a, b)
            has = low[:, 0] >= 0
            sig = pa.ListArray.from_arrays(pa.array(np.arange(int(has.sum()) + 1, dtype=np.int32) * n), pa.array(low[has].ravel()))
            kept = [batch.column(c).filter(pa.array(has)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, sig], names=[*keep, "sig"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    each = docs.select(*keep, t.words(F.col("text")).alias("_words")).mapInArrow(run, f"{kinds}, sig array<bigint>")
    mins = [F.min(F.col("sig")[i]).alias(f"m{i}") for i in range(n)]
    return each.groupBy(*keep).agg(*mins).select(*keep, F.array(*[f"m{i}" for i in range(n)]).alias("sig"))


def bands(sigs: DataFrame, keep: list[str], n: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """``keep``, band, key."""
    keys = [F.md5(F.array_join(F.slice("sig", i + 1, rows), ",").cast("binary")) for i in range(0, n, rows)]
    return sigs.select(*keep, F.posexplode(F.array(*keys)).alias("band", "key"))


def near_copies(docs: DataFrame, by: list[str] | None = None, width: int = SHINGLE) -> DataFrame:
    """doc_id, the columns ``by`` (the scope; none: all documents; nulls are one scope) and is_rejected of every document.

    Bands that one document has are dropped by the join; of a band that many have, only its smallest id is joined, and where it
    fills more than a small share of all rows, by broadcast.
    """
    by = by or []
    own = {c: f"_{c}" for c in by}
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()]
    b = cut(bands(signatures(docs, ["doc_id", *by], width), ["doc_id", *by]), "bands")
    # bands and scopes go by one digest, so that a null scope is a key like others
    b = b.withColumn("_scope", F.sha2(F.to_json(F.struct("band", "key", *by), {"ignoreNullFields": "false"}), 256))
    seen = cut(b.groupBy("_scope").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "seen")
    later = join_heads(b, seen, ["_scope"], "n", b.count()).where("doc_id > first").select("doc_id", *by).distinct()
    later = later.withColumnsRenamed({"doc_id": "_doc_id", **own}).withColumn("is_rejected", F.lit(True))
    out = docs.select("doc_id", *by).join(later, [F.col("doc_id") == F.col("_doc_id"), *same], "left")
    return out.select("doc_id", *by, F.coalesce("is_rejected", F.lit(False)).alias("is_rejected"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id, first_id (the smallest with the same text) and is_rejected. Texts move as digests."""
    d = cut(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")), "digests")
    first = cut(d.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    out = join_heads(d, first, ["digest"], "n", d.count(), "left")
    first_id = F.coalesce("first_id", "doc_id")
    return out.select("doc_id", first_id.alias("first_id"), (F.col("doc_id") > first_id).alias("is_rejected"))
