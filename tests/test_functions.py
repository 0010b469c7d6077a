import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexforge.functions import cipher
from lexforge.functions import text as t
from lexforge.functions.sql import register
from pyspark.sql import functions as F


def slow_poly(text, key_length, seed):
    """The cipher from its description, a character at a time."""
    sym = [chr(i) for i in range(0x250) if unicodedata.category(chr(i)) not in ("Cc", "Cf", "Cs", "Co", "Cn")]
    random.Random(seed).shuffle(sym)
    at = {c: i for i, c in enumerate(sym)}
    draw = lambda n: random.Random(seed).choices(sym, k=n)
    key = draw(key_length) if key_length else draw(10_000) + draw(max(0, len(text) - 10_000))
    return "".join(sym[(at[c] + at[key[i % len(key)]]) % len(sym)] if c in at else c for i, c in enumerate(text))


EDGE = ["", "\n", "é漢😀a", "­ɏɐ", "x" * 9_999, "y" * 10_000, "z" * 10_001, "ab漢" * 6_667, "Hello!"]


@pytest.mark.parametrize("k", [0, 1, 3, 100, 10_000])
def test_cipher_edges(k):
    got = cipher.shifted(pa.array([*EDGE, None]), 1234, k).to_pylist()
    assert got == [slow_poly(x, k, 1234) for x in EDGE] + [None]
    assert cipher.shifted(pa.array(got), 1234, k, -1).to_pylist() == [*EDGE, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6), st.sampled_from([0, 1, 7]), st.integers(0, 5))
def test_cipher_roundtrip(texts, k, skip):
    a = pa.array([*(["pad"] * skip), *texts], pa.string()).slice(skip)
    out = cipher.shifted(a, 5, k)
    assert out.to_pylist() == [slow_poly(x, k, 5) for x in texts]


def test_alphabet():
    assert len(cipher.symbols(1)) == 526


def test_translate_is_the_cipher(spark):
    d = spark.createDataFrame([(x,) for x in EDGE], "text string")
    got = d.select("text", cipher.poly(F.col("text"), 1, 9).alias("x")).collect()
    assert all(r.x == slow_poly(r.text, 1, 9) for r in got)


def test_cipher_does_not_depend_on_partitions(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = [sorted(d.repartition(n).select("doc_id", cipher.poly(F.col("text"), 0).alias("x")).collect()) for n in (1, 7)]
    assert out[0] == out[1]


def test_chacha_vectors():
    zero = cipher.keystream(bytes(32), bytes(8), 128)
    assert zero[:32].hex() == "76b8e0ada0f13d90405d6ae55386bd28bdd219b8a08ded1aa836efcc8b770dc7"
    assert cipher.keystream(bytes(31) + b"\1", bytes(8), 16).hex() == "4540f05a9f1fb296d7736e7b208e3c96"
    assert cipher.keystream(bytes(32), bytes(7) + b"\1", 16).hex() == "de9cba7bf3d69ef5e786dc63973f653a"
    assert cipher.seeded_bytes(3, 32)[:8] == cipher.seeded_bytes(3, 8)


def test_chacha_lines(spark):
    d = spark.createDataFrame([("a" * 200,), ("",), (None,)], "text string")
    got = [r.x for r in d.select(cipher.chacha20(F.col("text"), bytes(32), bytes(8)).alias("x")).collect()]
    assert "\n" not in got[0] and len(got[0]) == 268 and got[1:] == ["", None]


def test_dates(spark):
    cases = {"2024-01-02": 1, "2024-01-02x": 1, "12-34abc": 1, "1/5": 1, "1/5x": 0, "1-5": 1, "1-5x": 0, "5月3日": 1, "5月3": 1, "x2024-01-02": 0, "٣٣-٣": 1}
    d = spark.createDataFrame([(k,) for k in cases], "x string").select("x", F.col("x").rlike(t.DATE).alias("hit"))
    assert {r.x: int(r.hit) for r in d.collect()} == cases


def test_similarity(spark):
    d = spark.createDataFrame([("", ""), ("a", ""), ("abc", "abc"), ("abcd", "abxd")], "a string, b string")
    assert [r.s for r in d.select(t.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [None, 0.0, 1.0, 0.75]


def test_keyword_ratio(spark):
    rows = [("k " * 1 + "w " * 99,), ("k " * 2 + "w " * 99,), ("",), (None,)]
    got = spark.createDataFrame(rows, "x string").select(t.keyword_ratio_exceeds(F.col("x"), "k").alias("r")).collect()
    assert [bool(r.r) for r in got] == [False, True, False, False]


def test_sha256_mod(spark):
    import hashlib

    d = spark.createDataFrame([("Spark",), ("",), ("漢",)], "x string").select("x", t.sha256_mod(F.col("x"), 97).alias("m"))
    assert all(r.m == int(hashlib.sha256(r.x.encode()).hexdigest(), 16) % 97 for r in d.collect())


def test_script_words(spark):
    d = spark.createDataFrame([("漢字かなカナ abc12 x",)], "x string").select(t.script_words(F.col("x")).alias("w"))
    assert d.first().w == ["漢字", "かな", "カナ", "abc12", "x"]


def test_sql_functions(spark):
    register(spark, 7)
    r = spark.sql("select lev_sim('abcd', 'abxd') s, word_count(' a b\\n c') n, words('a  b') w, mask_pii('x a.b@c.org +1 (663) 555-6869') m, poly_decrypt(poly_encrypt('Hello!', 100), 100) p").first()
    assert (r.s, r.n, r.w, r.m, r.p) == (0.75, 3, ["a", "b"], "x <EMAIL> <PHONE>", "Hello!")


@pytest.mark.parametrize("k", [0, 7, 100])
def test_cipher_by_pieces(monkeypatch, k):
    monkeypatch.setattr(cipher, "PIECE", 5)
    texts = [*EDGE[:4], "", "漢" * 9, "ab😀é" * 3_000, "", *EDGE[-2:], ""]
    got = cipher.shifted(pa.array([*texts, None, "z"]), 1234, k)
    assert got.to_pylist() == [slow_poly(x, k, 1234) for x in texts] + [None, slow_poly("z", k, 1234)]


def test_cipher_memory_is_bounded():
    import tracemalloc

    texts = pa.array(["abcdé " * 700_000] + ["word " * 500] * 800)
    cipher.shifted(texts.slice(1, 1), 1234, 100)
    tracemalloc.start()
    cipher.shifted(texts, 1234, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * texts.nbytes + 60 * cipher.PIECE


def test_words_at_every_white_space(spark):
    white = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = ["", " ", "a", " é漢 ", "a​b\x1bc᠎d😀", *(f"{c}a{c}{c}ü{c}" for c in white), "".join(white), None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string").select("i", t.words(F.col("x")).alias("w"), t.word_count(F.col("x")).alias("n"), t.two_words(F.col("x")).alias("two"))
    want = [None if x is None else x.split() for x in texts]
    assert [(r.w, r.n, r.two) for r in rows.orderBy("i").collect()] == [(w, None, None) if w is None else (w, len(w), len(w) > 1) for w in want]


@pytest.mark.parametrize("name", ["compose_pipeline", "prompt_continuation_split"])
def test_words_are_cut_once(spark, sf, name):
    from lexforge.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert t.WORD not in plan and plan.count(f", {t.GAP}, -1)") == {"compose_pipeline": 2, "prompt_continuation_split": 1}[name]
