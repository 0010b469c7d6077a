"""Toxicity, license scans and the whole pipeline against plain Python, written from what they promise."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from lexforge.llm import licenses, secrets, toxicity
from lexforge.llm.packing import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LENGTH = 4096


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


@pytest.fixture(scope="module")
def docs(sf):
    """doc_id: (text, source, lang)."""
    found = duckdb.connect().execute(f"select doc_id, text, source, lang from '{sf}/documents.parquet'").fetchall()
    assert len({r[0] for r in found}) == len(found)
    return {i: x for i, *x in found}


@pytest.fixture(scope="module")
def labels(sf):
    return duckdb.connect().execute(f"select doc_id, toxic from '{sf}/labels.parquet' where toxic is not null").fetchall()


def grams(text):
    """The buckets of a text's n-grams of bytes, by the hash as it is defined."""
    raw = b" " * 6 + re.sub(rb"[\x09-\x0D]", b" ", lower(text).encode()) + b" " * 6
    found = set()
    for order in (3, 4, 5, 6):
        for k in range(len(raw) - order + 1):
            h = 0
            for b in raw[k : k + order]:
                h = (h * 0x01000193 + b) % 2**32
            found.add((((h ^ (h >> 15)) * 0x9E3779B1 + order * 0x85EBCA6B) % 2**32) >> 14)
    return found


def toxic_scores(texts, labels):
    """doc_id: score. ``texts`` by doc_id."""
    every = {i: grams(t) for i, t in texts.items()}
    train = [(i, int(y > 0)) for i, y in labels if i in texts and zlib.crc32(str(i).encode()) % 3 != 1]
    n, seen = Counter(y for _, y in train), (Counter(), Counter())
    for i, y in train:
        seen[y].update(every[i])
    ratio = {b: math.log((seen[1][b] + 0.5) / (n[1] + 1)) - math.log((seen[0][b] + 0.5) / (n[0] + 1)) for b in seen[0] | seen[1]}
    gain = {b: (seen[1][b] / n[1] - seen[0][b] / n[0]) * max(r, 0) for b, r in ratio.items() if seen[0][b] + seen[1][b] >= 2}
    best = sorted(sorted((b for b in gain if gain[b] > 0), key=lambda b: (-gain[b], b))[: toxicity.FEATURES])
    x = np.array([[ratio[b] * (b in every[i]) for b in best] for i, _ in train])
    y = np.array([y for _, y in train])
    # classes of equal weight, accelerated gradient steps
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    scale = (x * x).sum(1).mean()
    w = v = np.zeros(len(best))
    c = vc = 0.0
    for t in range(1, 401):
        aw, ac = w + t / (t + 3) * v, c + t / (t + 3) * vc
        g = (1 / (1 + np.exp(-(x @ aw + ac))) - y) * share
        nw, nc = aw - 2 / scale * (x.T @ g + 0.02 * scale / len(best) * aw), ac - g.sum()
        v, vc, w, c = nw - w, nc - c, nw, nc
    weight = dict(zip(best, w * [ratio[b] for b in best], strict=True))
    return {i: 1 / (1 + math.exp(-c - sum(weight.get(b, 0) for b in g))) for i, g in every.items()}


@pytest.fixture(scope="module")
def expected_scores(docs, labels):
    return toxic_scores({i: x[0] for i, x in docs.items()}, labels)


def test_toxicity(spark, sf, docs, expected_scores):
    got = toxicity.op7_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert abs(r.score - expected_scores[r.doc_id]) < 2e-3 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == (r.score >= 0.7)


def license_verdict(text):
    """labels, score and number of spans."""
    words = re.findall(licenses.WORDS, lower(text))
    base = {k for k, p in licenses.PHRASES if any(words[j : j + len(p.split())] == p.split() for j in range(len(words)))}
    found = []
    for t, (label, _, notice) in enumerate(licenses.TEMPLATES):
        want = re.findall(licenses.WORDS, lower(notice))
        diagonals = defaultdict(list)
        for j in range(len(want) - 2):
            for i in range(len(words) - 2):
                if words[i : i + 3] == want[j : j + 3]:
                    diagonals[i - j].append((i, j))
        islands = []
        for d in sorted(diagonals):
            if not islands or d - islands[-1][0] > licenses.SLACK:
                islands.append([d, []])
            islands[-1][0] = d
            islands[-1][1] += diagonals[d]
        for _, hits in islands:
            first, last = min(hits)[0], max(hits)[0] + 2
            covered = len({j for _, j in hits})
            cover, dense = covered / (len(want) - 2), min(1.0, (covered + 2) / (last - first + 1))
            found.append((first, last, t, label, cover, dense, cover >= licenses.COVER and dense >= licenses.DENSE))
    runs, reach = [], None
    for s in sorted(found):
        if reach is None or s[0] > reach:
            runs.append([])
        reach = s[1] if reach is None else max(reach, s[1])
        runs[-1].append(s)
    holds = []
    for run in runs:
        good = [s for s in run if s[6]]
        holds += [s for s in good if s[4] * s[5] >= max(x[4] * x[5] for x in good) or 2 * (s[1] - s[0] + 1) < max(x[1] - x[0] + 1 for x in good)]
    score = 1.0 if base else max((s[4] * s[5] for s in found), default=0.0)
    return ",".join(sorted(base | {s[3] for s in holds})), score, len(holds)


def test_licenses(spark, docs):
    """All documents, and notices of several templates with words lost, added and swapped, one after another and within others."""
    r = random.Random(5)
    made = {}
    for k in range(120):
        words = []
        for _ in range(r.randrange(1, 4)):
            w = r.choice(licenses.TEMPLATES)[2].split()
            for _ in range(r.randrange(0, 1 + len(w) // 4)):
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = r.choice([[], ["other"], ["The", "license"], [w[at].upper()]])
                w = w or ["none"]
            at = r.randrange(len(words) + 1)
            words[at:at] = [*w, *["filler"] * r.randrange(9)]
        made[-1 - k] = " ".join(words)
    texts = {i: x[0] for i, x in docs.items()} | made
    got = licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    some = 0
    for x in got:
        labels, score, n = license_verdict(texts[x.doc_id])
        assert (x.labels, x.n_spans) == (labels, n) and abs(x.score - score) < 1e-12, texts[x.doc_id]
        some += n > 1
    assert some > 10


def near_roots(texts):
    """The smallest doc_id of each group of near copies, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and group[a] is not group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return {min(g) for g in group.values()}


def without_secrets(docs):
    """doc_id: the text with each run of spans replaced."""
    owners, places = defaultdict(set), defaultdict(set)
    found = {}
    kinds = [(k, p, g, n, True) for k, p, g, n in secrets.BASE]
    kinds += [(k, secrets.KEY if k == "key" else p, g, n, False) for k, p, g, n in secrets.EXTRA]
    for i, (text, source, lang) in docs.items():
        found[i] = []
        for k, pattern, g, n, base in kinds:
            for m in re.finditer(pattern, text or "", re.ASCII):
                value = m[g]
                if k == "key":
                    value = re.sub(r"[^A-Za-z0-9+/=]", "", re.sub(r"-----(?:BEGIN|END) [A-Z ]{0,30}PRIVATE KEY-----", "", m[0])) or m[0]
                elif len(value) < n:
                    continue
                digest = hashlib.sha256(value.encode()).digest()
                owners[digest].add(source)
                places[digest].add((source, lang))
                found[i].append((m.start(), m.end(), digest, base))
    out = {}
    for i, (text, *_) in docs.items():
        spans = sorted(s[:2] for s in found[i] if s[3] or len(owners[s[2]]) <= secrets.MAX_OWNERS and len(places[s[2]]) <= secrets.MAX_REPOSITORIES)
        new, at = "", 0
        for a, b in spans:
            if a >= at:
                new += text[at:a] + "<secret>"
            at = max(at, b)
        out[i] = new + text[at:] if text is not None else None
    return out


def mix_targets(per):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(per, key=lambda s: (s is None, s)))}
    target, open_, left = {}, set(per), sum(per.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * per[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3 * per[s]
            left -= target[s]
        open_ -= full
    return target


def test_whole_pipeline(spark, sf, docs, expected_scores):
    """Which documents are left and with which texts is computed here; what the mix draws is read from the pieces, each of which has to be
    one of such a text; sources have to meet their targets, sequences to be gapless and full."""
    from tokenizers import Tokenizer

    assert all(abs(s - toxicity.THRESHOLD) > 2e-3 for s in expected_scores.values())
    left = {i: x for i, x in docs.items() if expected_scores[i] < toxicity.THRESHOLD}
    assert len(left) < len(docs)
    roots = near_roots({i: x[0] for i, x in left.items()})
    assert len(roots) < len(left)
    texts = without_secrets({i: left[i] for i in roots})
    assert any(texts[i] != docs[i][0] for i in texts)
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    per = Counter()
    for i in texts:
        per[docs[i][1]] += size[i]

    tokenizer = Tokenizer.from_file(vocabulary())

    def pieces(text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        return [(k, a, len(ids[a : a + LENGTH]), zlib.crc32(np.array(ids[a : a + LENGTH], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), LENGTH))]

    got = corpus_pipeline.run(spark, sf).collect()
    rows = defaultdict(Counter)
    for r in got:
        rows[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
    assert set(rows) <= {i for i in texts if size[i]}
    taken, cut = Counter(), Counter()
    for i, have in rows.items():
        whole = pieces(texts[i])
        copies = have[whole[-1]]
        rest = have - Counter(dict.fromkeys(whole, copies))
        assert sum(rest.values()) == sum(have.values()) - copies * len(whole)
        words = copies * size[i]
        if rest:  # one that was cut after a word
            ends = [m.end() for m in WORD.finditer(texts[i])][:-1]
            words += next(k for k, e in enumerate(ends, 1) if Counter(pieces(texts[i][:e])) == rest)
            cut[docs[i][1]] += 1
        assert words <= 3 * size[i]
        taken[docs[i][1]] += words
    target = mix_targets(per)
    assert all(abs(taken[s] - target[s]) <= 1 and cut[s] <= 1 for s in per), json.dumps([dict(taken), target], default=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= LENGTH
    assert len(bins) <= 1.05 * sum(r.length for r in got) / LENGTH + 1
