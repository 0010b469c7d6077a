"""Private keys are counted by their bodies, and redacted whole."""

import base64
import random

from lexforge.llm import secrets

BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def lines(seed, n=900):
    b = base64.b64encode(random.Random(seed).randbytes(n)).decode()
    return [b[i : i + 64] for i in range(0, len(b), 64)]


def key(seed, sep="\n"):
    return sep.join([BEGIN, *lines(seed), END])


def test_private_keys(spark):
    rows = [(i, f"before {i} {key(i)} after it", f"s{i}") for i in range(20)]  # one header, 20 owners, 20 keys
    rows += [(100 + i, f"see {key(99, sep)} there", f"s{i}") for i, sep in enumerate(("\n", "\r\n", "\\n", '\\n" +\n    "'))]  # one key, four owners, lines broken differently
    cut_off = BEGIN + "\n" + "\n".join(lines(200))
    rows += [(200, f"{cut_off}\nThen some words, and {key(201)} too", "s0")]
    encrypted = "\n".join([BEGIN, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B2C3D", "", *lines(202)])
    rows += [(202, f"{encrypted}\n{END} tail", "s1"), (203, encrypted.replace(lines(202)[0], lines(203)[0]), "s1")]
    rows += [(300 + i, f"A key starts with {BEGIN} and more follows here", f"s{i}") for i in range(5)]
    d = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, source string, lang string")
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "key"] for r in secrets.secret_spans(d).collect()}
    text = {i: t for i, t, _ in rows}
    for i in range(20):
        assert [text[i][a:b] for a, b in spans[i]] == [key(i)]
    assert not any(spans[i] for i in (*range(100, 104), *range(300, 305)))
    assert [text[200][a:b] for a, b in spans[200]] == [cut_off, key(201)]
    assert [text[202][a:b] for a, b in spans[202]] == [f"{encrypted}\n{END}"]
    assert spans[203] == [(0, len(text[203]))]
    clean = {r.doc_id: r.text for r in secrets.redacted(d).collect()}
    assert all(clean[i] == f"before {i} <secret> after it" for i in range(20))
    assert clean[200] == "<secret>\nThen some words, and <secret> too"
    assert clean[300] == text[300]


def test_very_long_body(spark):
    """The pattern alone: no recursion by line."""
    body = "\n".join(lines(1, 1_000_000))
    d = spark.createDataFrame([(1, f"{BEGIN}\n{body}"), (2, f"{BEGIN}\n{body}\n{END}")], "doc_id long, text string")
    got = {r.doc_id: [s.end for s in r.spans] for r in d.select("doc_id", secrets.matches(d.text, secrets.KEY, 0, 1, secrets.key_body).alias("spans")).collect()}
    assert got == {1: [len(BEGIN) + 1 + len(body)], 2: [len(BEGIN) + len(body) + len(END) + 2]}
