import bz2
import datetime
import gzip
import hashlib
import json
from collections import Counter

import pytest
from lexforge.functions import text as t
from lexforge.operators import corpus, dedup, filters, scoring, split
from lexforge.shared import running
from lexforge.sources import files, manifests, sinks
from lexforge.streaming import documents as stream
from pyspark.sql import functions as F


def test_running_sum(spark):
    rows = [(i, (i * 7) % 11) for i in range(500)]
    d = spark.createDataFrame(rows, "id long, n long").repartition(9)
    got = {r.id: r.before for r in running(d, [F.col("id")], F.col("n")).collect()}
    want, total = {}, 0
    for i, n in rows:
        want[i], total = total, total + n
    assert got == want


def test_bounds():
    assert split.bounds(2_237_032) == [2_122_943, 2_234_795, 2_237_032]


def test_sample_too_small(spark):
    with pytest.raises(ValueError):
        split.sample_exact(spark.range(3).withColumnRenamed("id", "doc_id"), 4)


def test_first_rejection_wins(spark):
    chain = filters.Chain([filters.nonempty(), filters.pattern_count("a", "a", 0), filters.pattern_count("b", "b", 0), filters.mask_pii()])
    d = spark.createDataFrame([(1, "ab"), (2, "b"), (3, ""), (4, None), (5, "x y@z.org")], "doc_id long, text string")
    out = chain.apply(d)
    assert [(r.reject_reason, r.text) for r in out.orderBy("doc_id").collect()] == [("a", "ab"), ("b", "b"), ("empty", ""), ("empty", None), (None, "x <EMAIL>")]
    s = chain.statistics(out).first()
    assert (s.n_docs, s.n_rejected, s.kept_chars, s.rejected_a, s.rejected_b, s.rejected_empty) == (5, 4, 9, 1, 1, 2)


def test_chain_names():
    with pytest.raises(ValueError):
        filters.Chain([filters.nonempty(), filters.nonempty()])


def test_no_python_in_native_chain(spark, sf):
    chain = filters.Chain([filters.nonempty(), filters.keyword_ratio("k", "that"), filters.oneword_lines(), filters.dates(), filters.mask_pii()])
    plan = chain.apply(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, base, "a"), (2, base + " end", "a"), (3, base, "b"), (4, "other words here", "a"), (5, "", "a"), (6, None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in dedup.near_copies(d).collect() if r.is_rejected} == {2, 3}
    assert {r.doc_id for r in dedup.near_copies(d, ["source"]).collect() if r.is_rejected} == {2}


def test_word_frequency_by_parts(spark, monkeypatch):
    """Words are moved as bytes of their part; the greatest counts, and at equal counts the first words, are all there whatever a task leaves out."""
    words = [f"w{i:03}" for i in range(300)] + ["é" * 9, "\U0001f600", "x" * 70_000]
    rows = [(k, " ".join(w for i, w in enumerate(words) if i % 5 <= k % 5)) for k in range(23)] + [(23, None), (24, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = Counter(w for _, x in rows for w in (x or "").split())
    assert "HashAggregate" not in corpus.word_frequency(d)._jdf.queryExecution().executedPlan().toString()
    for counted, parts in ((corpus.COUNTED, corpus.PARTS), (1, 3), (2000, 1)):
        monkeypatch.setattr(corpus, "COUNTED", counted)
        monkeypatch.setattr(corpus, "PARTS", parts)
        got = [tuple(r) for r in corpus.word_frequency(d).collect()]
        assert sorted(got) == sorted(want.items())
        for most in (1, 7, 61, 1000):
            first = corpus.word_frequency(d, most).orderBy(F.desc("n"), "word").limit(most).collect()
            assert list(map(tuple, first)) == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:most]


def test_few_tasks_send_words_to_the_driver(spark, monkeypatch):
    """However many tasks count, at most FAN of them have rows, and the vocabulary is that of all words."""
    monkeypatch.setattr(corpus, "FAN", 2)
    monkeypatch.setattr(corpus, "COUNTED", 1)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = [(k, " ".join(f"w{i}" for i in range(k, k + 40))) for k in range(0, 400, 7)]
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        want = Counter(w for _, x in rows for w in x.split())
        f = corpus.word_frequency(d, 20)
        assert f.rdd.getNumPartitions() <= 2
        assert corpus.vocabulary(d, 20 + len(corpus.SPECIAL)) == [w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:20]]
        assert corpus.vocabulary(d.where("doc_id < 0")) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_packing(spark):
    d = spark.createDataFrame([(i, list(range(i * 10, i * 10 + i))) for i in range(1, 8)], "doc_id long, token_ids array<int>")
    every = [x for i in range(1, 8) for x in range(i * 10, i * 10 + i)]
    got = {r.sample_id: r.token_ids for r in corpus.packed(d, 5).collect()}
    assert got == {k: every[5 * k : 5 * k + 5] for k in range(len(every) // 5)}


@pytest.mark.parametrize("length, block", [(1, 1), (4, 3), (5, 64), (50, 8)])
def test_packing_blocks(spark, monkeypatch, length, block):
    """Blocks shorter and longer than a sample; rows with one key, without a key and without tokens are packed once each."""
    monkeypatch.setattr(corpus, "BLOCK", block)
    rows = [(i, list(range(i * 100, i * 100 + i * 7 % 23))) for i in range(40)] + [(7, [70_001, 70_002]), (7, [70_003]), (None, [80_001, 80_002]), (50, None), (51, [])]
    d = spark.createDataFrame(rows, "doc_id long, token_ids array<int>").repartition(6)
    got = {r.sample_id: r.token_ids for r in corpus.packed(d, length).collect()}
    flat = [x for _, ids in sorted(got.items()) for x in ids]
    every = [x for k, ids in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)) for x in ids or []]
    assert sorted(got) == list(range(len(every) // length)) and all(len(x) == length for x in got.values())
    sevens = slice(*(every.index(x) for x in (700, 800)))
    assert flat[: sevens.start] == every[: sevens.start] and flat[sevens.stop :] == every[sevens.stop : len(flat)]
    assert sorted(flat[sevens]) == sorted(every[sevens]) and [x for x in flat[sevens] if x < 1000] == every[sevens][:3]


def test_packing_texts(spark, monkeypatch):
    """Ids kept as bytes, of two and of four each, and digests of samples are those of token lists."""
    monkeypatch.setattr(corpus, "BLOCK", 16)
    d = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 9))) for i in range(30)] + [(30, None)], "doc_id long, text string")
    for vocab in ([f"w{j}" for j in range(6)], [f"x{j}" for j in range(70_000)] + ["w3"]):
        want = {r.sample_id: hashlib.md5(" ".join(map(str, r.token_ids)).encode()).hexdigest() for r in corpus.packed(corpus.tokenised(d, vocab), 6).collect()}
        got = {r.sample_id: r.digest for r in corpus.packed_texts(d, vocab, 6, form=corpus.as_digests, kind="digest string").collect()}
        assert got == want and len(got) > 20


def test_packing_has_no_join_by_document(spark):
    """Samples come of blocks as they lie; tokens are not dealt by document again."""
    d = spark.createDataFrame([(1, [1, 2, 3])], "doc_id long, token_ids array<int>")
    assert "doc_id" not in corpus.packed(d, 2)._jdf.queryExecution().executedPlan().toString()


def test_tokenizer_file(spark):
    P = pytest.importorskip("public_tokenizers")
    d = spark.createDataFrame([(1, "hello world"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.token_ids for r in corpus.tokenised_by_file(d, P.path("byte_bpe_50k.json"), 50_256).collect()}
    assert got[2] == [50_256] and len(got[1]) == 3


@pytest.mark.parametrize("n", [511, 512, 513, 1024, 1025, 4000])
def test_windows(spark, n):
    d = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.col("id").cast("double").alias("nll"))
    got = {r.window: (r.n_tokens, r.nll) for r in scoring.window_nll(d).collect()}
    want, end, k = {}, 0, 0
    while end < n:
        last, end = end, min((k * 512) + 1024, n)
        want[k] = (end - last, sum(range(last, end)) / (end - last))
        k += 1
    assert got == want


def test_prompt_split(spark):
    d = spark.createDataFrame([(list("abc"),), (list("ab"),)], "w array<string>").select(*scoring.prompt_split(F.col("w")))
    assert [tuple(r) for r in d.collect()] == [(["a", "b"], ["c"]), (["a"], ["b"])]


def test_jsonl(spark, tmp_path):
    lines = [json.dumps({"text": "a\nb", "id": 1}), "3", '{"text": "tru', "", json.dumps({"text": None, "k": "v"})]
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    assert sorted(r.text or "" for r in files.read(spark, "jsonl", str(tmp_path), "text string", glob="*.gz").collect()) == ["", "a\nb"]
    raw = files.raw_jsonl(spark, str(tmp_path)).where("text is not null").first()
    assert raw.extra == {"id": "1"}
    with pytest.raises(ValueError):
        files.read(spark, "nothing")


def test_wiki_dump(spark, tmp_path):
    page = lambda i, ns, more, texts: f"<page><title>T{i}</title><ns>{ns}</ns><id>{i}</id>{more}" + "".join(f"<revision><id>9</id><text>{x}</text></revision>" for x in texts) + "</page>"
    xml = "<mediawiki>" + page(1, 0, "", ["", "body"]) + page(2, 1, "", ["talk"]) + page(3, 0, '<redirect title="T1" />', ["r"]) + page(4, 0, "", []) + "</mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    assert sorted(map(tuple, files.wiki_dump(spark, str(tmp_path / "d.xml.bz2")).collect())) == [(1, "T1", "body"), (4, "T4", None)]


def test_manifests(spark):
    for bad in (("train", -1, 2), ("train", 5, 2), ("train", 0, 1025), ("other", 0, 1)):
        with pytest.raises(ValueError):
            manifests.shards(spark, *bad)


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "s"), (2, "", "s"), (3, "c", "t")], "doc_id long, text string, source string")
    out = filters.Chain([filters.nonempty()]).apply(d)
    p = str(tmp_path)
    sinks.accepted_and_rejected(out, f"{p}/out")
    assert {r.doc_id for r in spark.read.json(f"{p}/out/is_rejected=true").collect()} == {2}
    sinks.sharded(d, f"{p}/shards", "text", 4)
    assert spark.read.json(f"{p}/shards").count() == 3
    sinks.nonempty_jsonl(d, f"{p}/full")
    assert spark.read.json(f"{p}/full").count() == 2
    sinks.tokens(d, f"{p}/tok")
    sinks.tokens(d.limit(1), f"{p}/tok")
    assert spark.read.parquet(f"{p}/tok").count() == 3
    sinks.tsv(d, f"{p}/tsv")
    assert sorted(map(tuple, spark.read.csv(f"{p}/tsv", sep="\t", schema="a int, b string, c string").collect()), key=str) == [(1, "a", "s"), (2, None, "s"), (3, "c", "t")]
    sinks.merged(d, f"{p}/one")
    sinks.statistics(d.groupBy("source").count(), f"{p}/stats")
    assert spark.read.json(f"{p}/one").count() == 3 and spark.read.json(f"{p}/stats").count() == 2


def test_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, x, "s", at + datetime.timedelta(seconds=i)) for i, x in enumerate(["a b", "a b", "", "c"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string, ts timestamp").write.json(str(tmp_path / "in"))
    s = stream.first_seen(stream.filtered(stream.read_jsonl(spark, str(tmp_path / "in")), filters.Chain([filters.nonempty()])))
    for name, df, mode in (("seen", s, "append"), ("enciphered", stream.enciphered(stream.read_jsonl(spark, str(tmp_path / "in"))), "append"), ("counted", stream.counts(stream.read_jsonl(spark, str(tmp_path / "in"))), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.text for r in spark.table("seen").collect()) == ["", "a b", "c"]
    assert spark.table("enciphered").count() == 3 and spark.table("counted").first().n_docs == 4


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert dedup.near_copies(d).count() == dedup.exact_copies(d).count() == split.by_ranges(d.select("doc_id")).count() == 0
    assert corpus.packed(corpus.tokenised(d, [])).count() == 0
    assert d.select(t.sentences(F.col("text"))).count() == 0


def test_errors_and_bad_json_are_reasons(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "good one"}\n{"text": "bad"\n{"text": "fails"}\n{"text": null}\n')

    def change(x):
        if x == "fails":
            raise RuntimeError
        return x.upper()

    chain = filters.Chain([filters.Step("upper", change=t.guarded(change), may_fail=True), filters.nonempty()])
    out = chain.apply(files.jsonl(spark, str(tmp_path), keep_bad=True)).select("text", "reject_reason").collect()
    assert sorted(map(tuple, out), key=str) == sorted([("GOOD ONE", None), (None, "json"), ("fails", "error"), (None, "empty")], key=str)


def test_token_filters_of_ones_own(spark):
    d = spark.createDataFrame([(1, "漢字かな\n漢字\none two\nword"), (2, "3x 4 a")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in filters.Chain([filters.oneword_lines(t.script_words)]).apply(d).collect()}
    assert got[1] == "漢字かな\none two"
    got = {r.doc_id: r.text for r in filters.Chain([filters.dates(pattern=r"^\d"), filters.tokens("short", lambda x: F.length(x) < 2)]).apply(d).collect()}
    assert got[2] == "a"


def test_encipher_job_keeps_keys(spark, tmp_path):
    from lexforge.functions import cipher

    rows = [{"id": 1, "text": "Hello é漢", "meta": {"a": [1, 2]}}, {"text": "x", "url": None}, {"title": "no text"}]
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    sinks.enciphered_jsonl(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), "poly", 7, 100)
    out = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    back = spark.createDataFrame([(r["text"],) for r in out], "text string").select(cipher.unpoly(F.col("text"), 100, 7).alias("x"))
    assert [{**r, "text": b.x} for r, b in zip(out, back.collect(), strict=True)] == rows[:2] and list(out[0]) == ["id", "text", "meta"]
    with pytest.raises(ValueError):
        cipher.encipher("rot13", F.col("text"))


def test_tokenizer_equivalence(spark):
    P = pytest.importorskip("public_tokenizers")
    d = spark.createDataFrame([(1, "Hello  world"), (2, "")], "doc_id long, text string")
    a, b = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
    assert corpus.differing_ids(d, a, a).count() == 0
    assert {r.doc_id for r in corpus.differing_ids(d, a, b).collect()} == {1}
    assert corpus.sampled_sentences(d, 5).count() == 1


@pytest.mark.parametrize("heads", [0, 3, 1000])
def test_unigram_windows(spark, heads):
    import math
    from collections import Counter

    texts = {2: "a b c " * 500, 1: "a d " * 300, 5: None, 4: "", 9: "b " * 7 + "e", None: "f g g"}
    every = [w for k in (1, 2, 4, 9, None) for w in (texts[k] or "").split()]
    c, groups = Counter(every), {}
    for i, w in enumerate(every):
        groups.setdefault(0 if i < 1024 else (i - 1024) // 512 + 1, []).append(-math.log(c[w] / len(every)))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = scoring.unigram_windows(d, heads=heads)
    assert {r.window: (r.n_tokens, round(r.nll, 9)) for r in out.collect()} == {k: (len(x), round(sum(x) / len(x), 9)) for k, x in groups.items()}
    assert scoring.unigram_windows(d.where("doc_id < 0"), heads=heads).count() == 0


def test_signatures(spark):
    import hashlib

    texts = {1: "é漢 b\tc d e f g", 2: "a b", 3: "", 4: None, 5: " ".join(f"w{i % 700}" for i in range(2000))}
    out = dedup.signatures(spark.createDataFrame([*texts.items(), (2, "x y z")], "doc_id long, text string"), ["doc_id"])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # no row for each shingle
    want = {}
    for k, x in [*texts.items(), (2, "x y z")]:
        w = (x or "").split()
        s = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        h = [int(hashlib.md5(y.encode()).hexdigest()[:8], 16) for y in s]
        if h:
            sig = [min((y * a + b) % dedup.PRIME for y in h) for a, b in dedup.coefficients()]
            want[k] = [min(p) for p in zip(want[k], sig)] if k in want else sig
    assert {r.doc_id: r.sig for r in out.collect()} == want


def test_words_are_counted_and_looked_up_in_arrow(spark, monkeypatch):
    """words are no rows or arrays of the JVM; pieces and odd white space do not change their counts."""
    white = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [None, "", " 　", "a b a", *(f"{w}x{w}{w}y​z{w}" for w in white), "the " * 5000 + "end"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    want = Counter(w for x in texts for w in (x or "").split())
    for counted in (corpus.COUNTED, 1):
        monkeypatch.setattr(corpus, "COUNTED", counted)
        f = corpus.word_frequency(d)
        assert {r.word: r.n for r in f.collect()} == want
        assert "Generate" not in plan(f)
    vocab = corpus.vocabulary(d)
    tokens = corpus.tokenised(d, vocab[:3])
    ids = {w: i + len(corpus.SPECIAL) for i, w in enumerate(vocab[:3])}
    assert {r.doc_id: r.token_ids for r in tokens.collect()} == {i: [ids.get(w, corpus.UNKNOWN) for w in (x or "").split()] + [corpus.EOD] for i, x in enumerate(texts)}
    assert "split" not in plan(tokens)
