"""The functions as SQL functions of a session."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import cipher, text


def register(spark: SparkSession, seed: int = 1234) -> None:
    """Adds lev_sim, word_count, words, mask_pii (SQL bodies), poly_encrypt and poly_decrypt (Arrow; text, key length)."""
    q = lambda s: "r'" + s.replace("'", "\\'") + "'"
    bodies = {
        "lev_sim(a STRING, b STRING) RETURNS DOUBLE": "1 - levenshtein(a, b) / nullif(greatest(length(a), length(b)), 0)",
        "word_count(t STRING) RETURNS BIGINT": f"CAST(regexp_count(t, {q(text.WORD)}) AS BIGINT)",
        "words(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(t, {q(text.WORD)}, 0)",
        "mask_pii(t STRING) RETURNS STRING": f"regexp_replace(regexp_replace(t, {q(text.EMAIL)}, '<EMAIL>'), {q(text.PHONE)}, '<PHONE>')",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, sign in (("poly_encrypt", 1), ("poly_decrypt", -1)):

        def run(texts: pa.Array, length: pa.Array, sign=sign) -> pa.Array:
            found: dict[int, pa.Array] = {k: cipher.shifted(texts, seed, k, sign) for k in set(length.to_pylist())}
            return pa.array([found[k][i].as_py() for i, k in enumerate(length.to_pylist())], pa.string())

        run.__annotations__ = {"texts": pa.Array, "length": pa.Array, "return": pa.Array}
        spark.udf.register(name, F.arrow_udf(lambda t, k, run=run: run(t, k), "string"))
