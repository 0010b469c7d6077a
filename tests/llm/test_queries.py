"""The queries on the smallest tables: against DuckDB's SQL where there is some, else against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from lexforge.llm import html_cut, licenses, matroska, mixing, quality, registry
from lexforge.llm.kneser_ney import train
from lexforge.llm.packing import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.connect().execute(f"select doc_id, text, source from '{sf}/documents.parquet' order by doc_id").fetchall()


def rows(spark, sf, name):
    return {r.doc_id: r for r in registry.QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name", registry.ORACLES)
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = c.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    key = lambda x: tuple(map(str, x))
    assert sorted((key(r[c] for c in columns) for r in df.collect())) == sorted(key(r[names.index(c)] for c in columns) for r in want.fetchall())


def test_media(spark, sf, docs):
    got = rows(spark, sf, "op1_matroska")
    for i, text, _ in docs:
        raw = text.encode()
        full = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r.media_sha256 == hashlib.sha256(matroska.mux(full)).hexdigest()


def test_licenses(spark, sf, docs):
    got = rows(spark, sf, "op2_diagonals")
    word = re.compile(licenses.WORDS)
    for i, text, _ in docs:
        w = word.findall(lower(text))
        at = {k: [j for j in range(len(w)) if w[j : j + len(p.split())] == p.split()] for k, p in licenses.PHRASES}
        every = sum(at.values(), [])
        base = ",".join(sorted(k for k in at if at[k]))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(every), min(every, default=None), max(every, default=None), base)
        assert set(filter(None, base.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_mixing_repeated_rows(spark):
    """Equal rows are drawn each for itself: the words of the mix are the targets' words."""
    from pyspark.sql import functions as F

    rows_ = [(i, f"w{i} " * 50, "a") for i in range(20)] + [(100, "x " * 400, "b")] * 5 + [(1, "q " * 7, None)] * 200
    d = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    goal, x, drawn = mixing.plan(mixing.sizes(d))
    want = {r.source: r.target for r in goal.collect()}
    taken = {r[0]: r[1] for r in mixing.takes(x, drawn).join(x.select("doc_id", "row_hash", "copy", "source"), ["doc_id", "row_hash", "copy"]).groupBy("source").agg(F.sum("words")).collect()}
    mix = {r[0]: r[1] for r in mixing.mixed(d).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).collect()}
    assert set(want) == set(taken) == set(mix)
    assert all(abs(taken[s] - want[s]) <= 1 and mix[s] == taken[s] for s in want)
    # shards draw disjoint places, each source's all of them
    places = sorted((r.sid, r.place) for r in drawn.collect())
    assert len(set(places)) == len(places) and all(p == 0 or (s, p - 1) in set(places) for s, p in places)


def test_diagonals_find_and_merge(spark):
    mit = next(t for k, kind, t in licenses.TEMPLATES if k == "mit" and kind == "text").split()
    changed = mit[:20] + ["inserted"] + mit[20:50] + mit[52:]
    rows_ = [(1, "some words before " + " ".join(mit) + " and after"), (2, " ".join(changed)), (3, " ".join(mit[::-1])), (4, "Licensed under CC BY-NC 4.0. " * 2), (5, None)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["mit", "mit", "", "cc-by-nc", ""]


def test_mixing(spark, sf, docs):
    got = rows(spark, sf, "op3_splitting_tree")
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    per = Counter()
    for i, _, s in docs:
        per[s] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(per))}
    target, open_, left = {}, set(per), sum(per.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * per[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3 * per[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    for i, _, s in docs:
        r = got[i]
        assert r["size"] == size[i] and r.source_size == per[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * size[i]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in per)
    again = rows(spark, sf, "op3_splitting_tree")
    assert all(again[i].taken == got[i].taken and again[i].shards == got[i].shards for i in got)


@pytest.mark.parametrize("total,marked,drawn", [(10, 3, 5), (1, 1, 1), (50, 50, 20), (1000, 10, 500), (7, 0, 3)])
def test_hypergeometric(spark, total, marked, drawn):
    from pyspark.sql import functions as F

    us = [(k + 0.5) / 2000 for k in range(2000)]
    d = spark.createDataFrame([(u,) for u in us], "u double")
    n = Counter(r.n for r in d.select(mixing.hypergeometric(*[F.lit(x).cast("long") for x in (total, marked, drawn)], F.col("u")).alias("n")).collect())
    p = {k: math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn) for k in range(min(marked, drawn) + 1) if drawn - k <= total - marked}
    assert set(n) <= set(p) and all(abs(n[k] / 2000 - p[k]) < 0.002 for k in p)


def test_quality(spark, sf, docs):
    good = {i for i, q in duckdb.connect().execute(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall() if q}
    got = rows(spark, sf, "op4_log_ratio")
    one = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    two = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
    raw, target, grams = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), {}
    for i, text, _ in docs:
        w = WORD.findall(text or "")
        h = [one(x) for x in w]
        g = h + [two(a, b) for a, b in zip(h, h[1:])]
        grams[i] = [(x - (1 << 64) * (x >> 63)) % quality.BUCKETS for x in g]
        raw += np.bincount(grams[i], minlength=quality.BUCKETS)
        target += np.bincount(grams[i], minlength=quality.BUCKETS) * (i in good)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        five = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        rep = {j + k for j in range(len(w) - 4) if five[tuple(w[j : j + 5])] > 1 for k in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
    share = lambda c: np.log((c + 1) / (c.sum() + quality.BUCKETS))
    weight = share(target) - share(raw)
    for i, g in grams.items():
        want = weight[g].mean() if g else 0.0
        assert abs(got[i].llr - want) < 1e-4
        assert got[i].kept == (not got[i].base_failed and got[i].llr >= quality.THRESHOLD)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(spark, sf, "op7_toxicity")
    y = dict(duckdb.connect().execute(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    held = [(got[i].score, t) for i, t in y.items() if got[i].held_out]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == r.held_out and r.predicted == (r.score >= 0.7) for i, r in got.items())
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum(a > b for a in pos for b in neg) / (len(pos) * len(neg)) > 0.95
    assert np.mean([s >= 0.7 for s in neg]) < 0.05


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in docs}
    got = registry.QUERIES["op9_packing"](spark, sf).collect()
    bins = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length == min(4096, len(ids[r.doc_id]) - r.start) and r.start == 4096 * r.piece
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * sum(map(len, ids.values())) / 4096 + 1


def test_ids_are_the_tokenizers(monkeypatch):
    """Odd bytes, special tokens, runs without white space, and a table that has to forget."""
    import random

    import pyarrow as pa
    from lexforge.llm import packing
    from lexforge.llm.common import buffer

    monkeypatch.setattr(packing, "PARTS", 400)
    monkeypatch.setattr(packing, "CHUNK", 700)
    words, r = packing.Words(vocabulary()), random.Random(1)
    some = [*"abz AZ09.,'<|>é ÉßÀ×÷ªµ\t\n\x0b\x00\x1cİ漢ſКﬁ½²ñ", "e\u0301", "\u0085", "\u00a0", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'re", "don't", "x" * 30, "é" * 13, "word "]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(60))) for _ in range(1500)] + ["", "a" * 5000, "ab " * 5000, None]
    ids, cuts = words.ids(*buffer(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == words.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], t


def test_language_model(spark, sf, docs):
    got = rows(spark, sf, "op10_kneser_ney")
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t, _ in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    grams = Counter(g for i, w in tokens.items() if not held[i] for g in zip([None, None, *w], [None, *w], w))
    pair, before = Counter(), Counter()
    for (_, b, x), k in grams.items():
        pair[b, x] += k if b is None else 1
    for _, x in pair:
        before[x] += 1

    def discounts(counts):
        m = Counter(min(k, 5) for k in counts)
        y = m[1] / (m[1] + 2 * m[2])
        out = [k - (k + 1) * y * m[k + 1] / m[k] for k in (1, 2, 3)]
        return [0, *[x if 0 < x < k else k / 2 for k, x in enumerate(out, 1)]]

    d3, d2, d1 = discounts(grams.values()), discounts(pair.values()), discounts(before.values())
    total = sum(before.values())
    unknown = sum(d1[min(k, 3)] for k in before.values()) / total / (v + 1)

    def contexts(counts, d):
        every, rest = Counter(), Counter()
        for g, k in counts.items():
            every[g[:-1]] += k
            rest[g[:-1]] += d[min(k, 3)]
        return every, rest

    every3, rest3 = contexts(grams, d3)
    every2, rest2 = contexts(pair, d2)

    def p(g, lower, counts, every, rest, d):
        k, n = counts[g], every[g[:-1]]
        return (k - d[min(k, 3)]) / n * (k > 0) + rest[g[:-1]] / n * lower if n else lower

    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = 0.0
        for g in zip([None, None, *w], [None, *w], w):
            k = before[g[2]]
            one = unknown + ((k - d1[min(k, 3)]) / total if k else 0)
            score += math.log10(p(g, p(g[1:], one, pair, every2, rest2, d2), grams, every3, rest3, d3))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and abs(r.score - score) < 1e-4 * max(1, -score)


def test_stored_counts_come_back():
    """Counts and sums beyond what their codes hold, and hashes that are not there."""
    from lexforge.llm import kneser_ney as kn

    r = np.random.default_rng(1)
    h = np.unique(r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    c = np.where(r.random(len(h)) < 0.1, r.integers(1, 1 << 40, len(h)), r.integers(1, 6, len(h)))
    starts = np.sort(r.choice(np.arange(1, len(h)), 900, replace=False))
    starts = np.concatenate([[0], starts])
    d = [0.5, 1.0, 1.5]
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        for n in (1, 7, len(h)):
            kn._write(folder, 1, kn.counted(h[:n], c[:n]))
            got, there = kn.Lookup(f"{folder}/1").counts(np.concatenate([h, h + np.uint64(1 << 40)]))
            assert there.tolist() == list(range(n)) and got.tolist() == c[:n].tolist()
        kn._write(folder, 2, kn.summed(h[: len(starts)], c, starts))
        total, rest, there = kn.Lookup(f"{folder}/2").sums(h, d)
        ends = [*starts[1:].tolist(), len(c)]
        assert there.tolist() == list(range(len(starts)))
        for k, (i, j) in enumerate(zip(starts.tolist(), ends, strict=True)):
            assert total[k] == c[i:j].sum() and abs(rest[k] - sum(d[min(x, 3) - 1] for x in c[i:j]) / c[i:j].sum()) < 1e-12
    u, v, w = (r.integers(0, 40, 3000).astype(np.uint64) for _ in range(3))
    assert Counter(zip(u.tolist(), v.tolist(), w.tolist())) == Counter({(a, b, x): k for a, b, x, k in zip(*(y.tolist() for y in kn.decode(kn.encode(*kn._gathered(u, v, w)))))})


def test_model_does_not_depend_on_buckets(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (train(d, n)[0] for n in (2, 512))
    assert not len(a["heads"].words) and len(b["heads"].words)
    for name in a.keys() - {"buckets", "grams", "hbi", "words", "heads", "first"}:
        assert a[name] == pytest.approx(b[name])


def test_lost_model_file_is_an_error(spark, sf):
    from lexforge.llm.kneser_ney import _local, scores

    d = spark.read.parquet(f"{sf}/documents.parquet")
    totals, folder = train(d, 4)
    os.remove(f"{folder}/tri/1")
    with pytest.raises(Exception, match="No such file"):
        scores(d, totals, folder).collect()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./x", "file:///tmp")
    with pytest.raises(ValueError):
        _local(spark, "viewfs://store/x")


def test_pages(spark, sf):
    import html

    pages = {r.page_id: r for r in registry.QUERIES["op6_min_cut"](spark, sf).collect()}
    for i, page in duckdb.connect().execute(f"select page_id, html from '{sf}/pages.parquet'").fetchall():
        parts = re.split(r"</?(?:p|h1)>", page[page.find("<article>") + 9 :].split("</article>")[0])
        want = [" ".join(html.unescape(re.sub("<[^>]*>?", " ", x)).split()) for x in parts]
        assert pages[i].text == "\n\n".join(filter(None, want)) and pages[i].n_chars == len(pages[i].text)


def test_extract_edges():
    assert html_cut.extract(None) == html_cut.extract("") == html_cut.extract("<p>") == html_cut.extract("<script>x</script") == ""
    page = "<body><nav>Home</nav><main><p>One &amp; two\n three. Four &lt;b&gt; five words here.<!-- x --><br>More of it.<div class=ad>Buy now</div><p>Yes.</main><section id=comments><article class=comment><p>I think that this is a very long comment on it.</article></section>"
    assert html_cut.extract(page) == "One & two three. Four <b> five words here. More of it.\n\nYes."


def test_extract_keeps_what_is_not_listed():
    long = "This sentence of the article has enough words to be seen as one, and it ends well."
    page = f"<body><nav>Home</nav><article><p>We have <math><mi>x</mi></math> as known. {long}</p><div class='text related-work'><p>{long}</p></div><svg><text>t</text></svg><video><p>{long}</video></article><footer>f</footer>"
    assert html_cut.extract(page) == f"We have x as known. {long}\n\n{long}\n\n{long}"
    assert html_cut.extract(f"<body><main><p>{long}<svg><p>{long}</main>") == f"{long}\n\n{long}"


def test_extract_without_article():
    """Only words, links and neighbours say what is content."""
    text = [f"Paragraph {i} tells of things that happened in the town, and of people who were there at the time." for i in range(4)]
    menu = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(9))
    page = f"<body><div><ul>{menu}</ul></div><div>" + "".join(f"<p>{t}</p>" for t in text) + "</div><div><p>© 2024 Some Corp. All rights reserved</p></div>"
    assert html_cut.extract(page) == "\n\n".join(text)


def test_deep_pages_take_linear_time():
    import time

    began = time.process_time()
    html_cut.extract("<div>" * 8000 + "<header>x</header>" * 8000)
    assert time.process_time() - began < 5


def test_licenses_ask_letters_of_few_words_only(spark):
    """op2_diagonals: no text is lower-cased letter by letter; A-Z alone are lower-cased all the same."""
    notice = "\n-- THIS WORK IS Licensed under the GNU Lesser GENERAL Public License, version 3. UNDER the MIT liCENSE İ É"
    rows_ = [(1, notice), (2, notice.replace("WORK", "WOR\u212a")), (3, notice.replace("WORK", "WORø")), (4, "É" + notice.replace("MIT liCENSE", "MIT lıCENSE")), (5, "..."), (6, None)]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    out = licenses.license_scan(d)
    assert "translate(coalesce(text" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got[1] == (19, 1, 13, 13, "mit", "lgpl,mit", 1.0, 1) and got[2] == got[3]
    assert got[4][1:5] == (0, None, None, "") and got[4][5] == "lgpl" and got[5] == got[6] == (0, 0, None, None, "", "", 0.0, 0)
    spans = {}
    for r in licenses.spans(d).collect():
        spans.setdefault(r.doc_id, set()).add((r.label, r.template, r.first, r.last, r.cover, r.dense))
    assert spans[2] == spans[3] != spans[1]
