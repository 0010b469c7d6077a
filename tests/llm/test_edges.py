"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns for every operator and stage."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from lexforge.llm import bottom_k, html_cut, kneser_ney, licenses, matroska, mixing, packing, quality, secrets, toxicity
from lexforge.llm.html_cut import minimum_cut
from lexforge.llm.packing import sum_of_squares
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
SAME = " ".join(f"same{i}" for i in range(60))
ROWS = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, LONG, "en", "a", len(LONG)), (4, SAME, "en", "a", 1), (5, SAME, "en", "b", 1), (5, SAME, "en", "b", 1), (None, SAME + " x", "en", "c", 1), (None, None, None, None, None), (7, "password = abcdefgh12345678 under the MIT license", "de", "b", 5), (8, "é漢😀   x", "de", "b", 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = [(1, 1, 0), (4, 1, 1), (5, 0, 0), (5, 0, 1), (None, 1, 1), (99, 0, 0), (7, None, None)]
CLASH = ("score", "id", "value", "n", "a", "b", "words", "block", "digest", "size", "shard")


@pytest.fixture(scope="module")
def tables(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    more = d.withColumns({c: F.lit("x") for c in CLASH})
    return {"rows": (d, labels), "none": (d.limit(0), labels.limit(0)), "unlabelled": (d, labels.limit(0)), "clash": (more, labels)}


OPERATORS = {
    "media": lambda d, y: matroska.media_digests(d),
    "licenses": lambda d, y: licenses.license_scan(d),
    "quality": lambda d, y: quality.quality(d, y),
    "secrets": lambda d, y: secrets.secret_spans(d),
    "html": lambda d, y: html_cut.main_text(d.withColumnRenamed("text", "html").withColumns({"page_id": F.col("doc_id"), "url": F.lit("u")})),
    "toxicity": lambda d, y: toxicity.toxicity(d, y),
    "near": lambda d, y: bottom_k.near_duplicates(d),
    "model": lambda d, y: kneser_ney.language_model(d),
}


@pytest.mark.parametrize("kind", ["rows", "none", "unlabelled", "clash"])
@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(tables, name, kind):
    d, y = tables[kind]
    assert OPERATORS[name](d, y).count() == (0 if kind == "none" else len(ROWS))


@pytest.mark.parametrize("kind", ["rows", "none", "clash"])
def test_packing_edges(tables, kind):
    got = packing.packed(tables[kind][0], ["doc_id"]).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sum(r.piece == 0 for r in got) == (0 if kind == "none" else len(ROWS))


@pytest.mark.parametrize("kind", ["rows", "none", "clash"])
def test_mixing_edges(tables, kind):
    d = tables[kind][0]
    out = mixing.mixed(d).collect()
    assert all(r.text for r in out) and mixing.mixed(d).columns == d.columns
    assert bool(out) == (kind != "none")


def test_near_components(tables):
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in bottom_k.near_duplicates(tables["rows"][0]).collect())
    assert (5, 4, False) in got and (4, 4, True) in got and (3, 3, True) in got and (1, 1, True) in got


def test_hot_groups_against_brute_force(spark):
    """A large group of near copies, chains of links, and a passage that all share."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    base = [f"w{i}" for i in range(120)]
    for i in range(400):  # many long lists
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(120)] = f"x{i}_{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    for i in range(400, 600):
        rows.append((i, " ".join(passage + [f"u{i}_{k}" for k in range(r.randrange(2, 60))])))
    for i in range(600, 640):  # each is near the next one only
        rows.append((i, " ".join(f"c{k}" for k in range((i - 600) * 8, (i - 600) * 8 + 150))))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {x.doc_id: x.component_id for x in bottom_k.near_duplicates(d, 5).collect()} == {i: find(i) for i in root}


def test_minimum_cut():
    r = random.Random(1)
    for _ in range(300):
        k = r.randint(1, 7)
        s, t = ([r.randint(0, 9) for _ in range(k)] for _ in range(2))
        e = [(a, b, r.randint(0, 6)) for a in range(k) for b in range(a + 1, k) if r.random() < 0.5]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(k)) + sum(c for a, b, c in e if x[a] != x[b])  # noqa: B023, E731
        assert cost(minimum_cut(s, t, e)) == min(map(cost, itertools.product([False, True], repeat=k)))


def test_sum_of_squares_is_greedy():
    """Each piece goes where the sum of squares becomes smallest (a full bin counts for nothing)."""
    r = random.Random(2)
    lengths = [r.randint(1, 20) for _ in range(200)]
    got, place, made = sum_of_squares(__import__("numpy").array(lengths), 20)
    gaps = {}
    total = lambda g: sum(k * k for k in __import__("collections").Counter(x for x in g.values() if x).values())
    for n, b in zip(lengths, got.tolist(), strict=True):
        options = [total({**gaps, x: g - n}) for x, g in gaps.items() if g >= n] + [total({**gaps, "new": 20 - n})]
        gaps[b] = gaps.get(b, 20) - n
        assert gaps[b] >= 0
        assert n >= 20 or total(gaps) == min(options)
    assert made == len(gaps)


def test_matroska_laces_and_damage():
    frames = [bytes([i]) * n for i, n in enumerate((300, 5, 255, 0, 7))]
    head = matroska.element(matroska.EBML, matroska.element(0x4282, b"matroska"))
    tracks = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK, matroska.element(matroska.NUMBER, b"\1")))
    for how in (0, 1, 3):
        body = matroska.laced(frames[: 1 if not how else 5], how)
        block = matroska.element(matroska.SIMPLE, b"\x81\0\0" + bytes([0x80 | how << 1]) + body)
        for size in (None, b"\xff"):  # known, unknown
            cluster = matroska.element(matroska.TIMECODE, b"\5") + block
            cluster = matroska.element(matroska.CLUSTER, cluster) if size is None else matroska.uint(matroska.CLUSTER) + size + cluster
            data = head + matroska.uint(matroska.SEGMENT) + b"\xff" + tracks + cluster + cluster
            m = matroska.parse(data)
            assert m.status == "ok" and matroska.payload_of(data, m) == b"".join(frames[: 1 if not how else 5]) * 2
            assert m.packets[0][6] == 5_000_000
    whole = matroska.mux(bytes(range(256)) * 300)
    for n in range(0, len(whole), 997):
        m = matroska.parse(whole[:n])
        assert m.status != "ok" or not n and m.status == "not EBML"
        assert matroska.payload_of(whole, m) == (bytes(range(256)) * 300)[: sum(p[8] for p in m.packets)]
    assert matroska.parse(None).status == "null"


def test_packet_table(spark):
    """The rows' byte ranges give the payload back, times rise in a track, and cues name their clusters."""
    texts = {1: "abc " * 40_000, 2: None, 3: "", 4: "some words"}
    media = matroska.to_matroska(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    data = {r.doc_id: bytes(r.media) for r in media.collect()}
    every = matroska.packet_table(media, "doc_id", "media").collect()
    for i, text in texts.items():
        rows = [r for r in every if r.doc_id == i]
        assert b"".join(data[i][r.offset : r.offset + r.size] for r in rows) == matroska.padded((text or "").encode())
        times = [r.timestamp_ns for r in rows]
        assert times == sorted(times) and {r.status for r in rows} == {"ok"}
        clusters = matroska.parse(data[i]).clusters
        assert all(r.cue_offset in (None, clusters[r.cluster]) for r in rows) and any(r.cue_offset is not None for r in rows)
    broken = matroska.packet_table(spark.createDataFrame([(5, None), (6, b"no")], "doc_id long, media binary"), "doc_id", "media").collect()
    assert {(r.doc_id, r.track) for r in broken} == {(5, None), (6, None)} and all(r.status != "ok" for r in broken)


def test_near_dedup_by_brute_force(spark):
    """The pipeline's near-duplicate stage against all pairs of sets of five-word shingles."""
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {}
    for r in d.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, sf).select("doc_id").collect()) == [i for i in sorted(sets) if find(i) == i]


@pytest.mark.parametrize("kind", ["rows", "none", "clash"])
def test_stages_keep_columns(spark, tables, tmp_path, kind):
    d, y = tables[kind]
    y.write.parquet(f"{tmp_path}/labels.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        out.count()
    assert bool(corpus_pipeline.run(spark, str(tmp_path)).count()) == (kind != "none")


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.toxicity(spark, d, sf)
    rejected = {r.doc_id for r in toxicity.toxicity(d, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in d.select("doc_id").collect()} - rejected
    one = corpus_pipeline.near_dedup(spark, d, sf)
    roots = {r.component_id for r in bottom_k.near_duplicates(d, 5).collect()}
    assert sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(roots)
    clean = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, d, sf).collect()}
    spans = {r.doc_id: r.spans for r in secrets.secret_spans(d).collect()}
    for r in d.collect():
        text, at = "", 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                text += r.text[at : s.start] + "<secret>"
            at = max(at, s.end)
        assert clean[r.doc_id] == text + r.text[at:]


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def phrases(text):
    w = words_of(text, licenses.WORDS)
    return [j for _, p in licenses.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]


def repeats(w):
    five = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    return len({j + k for j in range(len(w) - 4) if five[tuple(w[j : j + 5])] > 1 for k in range(5)})


def model_tokens(text):
    learnt = {x for i, t, *_ in ROWS if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for x in words_of(t)}
    return len(words_of(text)) + 1, sum(x in learnt for x in words_of(text)) + 1


def payload(text):
    raw = (text or "").encode()
    full = raw + bytes(-len(raw) % 64 or 64 * (not raw))
    return len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])


#: By operator: columns, and what they hold for a row.
VALUES = {
    "media": (["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"], lambda i, t: payload(t)),
    "licenses": (["n_words", "n_base", "first_word", "last_word"], lambda i, t: (len(words_of(t, licenses.WORDS)), len(phrases(t)), min(phrases(t), default=None), max(phrases(t), default=None))),
    "quality": (["n_words", "word_chars", "n_repeat_words"], lambda i, t: (len(words_of(t)), sum(map(len, words_of(t))), repeats(words_of(t)))),
    "secrets": (["n_assign", "n_access", "n_hex", "n_live"], lambda i, t: (("password" in (t or "")) * 1, 0, 0, ("password" in (t or "")) * 1)),
    "toxicity": (["held_out"], lambda i, t: (zlib.crc32(str("" if i is None else i).encode()) % 3 == 1,)),
    "near": (["n_shingles"], lambda i, t: (len({tuple(w[k : k + 5]) for w in [words_of(t)] for k in range(max(1, len(w) - 4))}) * bool(words_of(t)),)),
    "model": (["n_tokens", "n_known"], lambda i, t: model_tokens(t)),
}


@pytest.mark.parametrize("name", VALUES)
def test_values_of_odd_rows(tables, name):
    """Each row's values, with other columns that have clashing names."""
    columns, want = VALUES[name]
    got = OPERATORS[name](*tables["clash"]).select("doc_id", *columns).collect()
    assert Counter(map(tuple, got)) == Counter((i, *want(i, t)) for i, t, *_ in ROWS)
