"""Op 10, LM scoring: an interpolated modified Kneser-Ney trigram model, counted in Spark, mapped by workers.

Counting
    Words become 48-bit codes of their hash (A-Z lower-cased). Each batch of texts is reduced to its trigrams u v w with
    counts and cut by the bucket of the middle word v; one row carries the run of one bucket. The runs of a bucket meet in one
    task, which merges them: it has all w after u v, all u before v w, and all pairs v w, so that trigrams, their contexts and the
    continuation counts of bigrams need one shuffle of trigrams. A middle word with several buckets' share of all tokens (a head; they
    are counted first, and at most as many as buckets) is split into parts by u; its pairs v w meet once more, by both words.
    Which words are heads changes no result. Continuation counts of words meet by bucket of w.

Model
    p(w|uv) = max(c(uvw) - D3(c), 0) / c(uv) + g(uv) p(w|v), p(w|v) = max(N(vw) - D2(N), 0) / N(v) + g(v) p(w),
    p(w) = max(N(w) - D1(N), 0) / N + g / (V + 1), where N(vw) counts the distinct words before v w (c(vw) where v begins a text), N(w) those
    before w, and the D are the discounts for counts 1, 2, 3 and more after Chen and Goodman. A text begins after two end
    tokens. An unknown word has g / (V + 1). The probabilities of all words and "unknown" add up to 1 in every context.

Storage
    For each bucket sorted arrays of hashes of trigrams, contexts, bigrams and words, as files in the shared folder: a directory
    of the first bits, 32 bits more of each hash, and counts in 1 or 2 bytes, with the few large ones aside. A lookup of what is not
    there hits with a chance of some 2e-9. Workers map the files, so that folder has to be mounted on all executors (an error says so before
    any work if it is not). A worker that does not find a file of the model fails; nothing is scored with a part of it. Codes
    that two of V words share: V * V / 2**49; in a trigram u has 40 of the bits, beside one v.

Defined results: a null or empty text is the end token alone; with nothing to learn from each token has
probability 1 (an empty table, or one of held-out rows); without rows to score the result is empty; repeated rows are learnt and
scored each; a very long text is one text like others; other columns are not read.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer, crc_mod, cut, mix, pieces, scratch_path, table, tidy, word_hashes

#: Least buckets of the model, and bytes of text to a bucket beyond that: a bucket is one task's work and memory.
BUCKETS = 64
BUCKET_BYTES = 1 << 25
#: Buckets' share of all tokens from which on a middle word is a head.
HEAD = 2
#: Mapped files that a worker keeps open.
OPEN = 4096
#: Tokens that a task reduces at a time.
RUN = 3_000_000
CODE = np.uint64((1 << 48) - 1)
NEAR = np.uint64((1 << 40) - 1)
END = np.uint64(0x2545F4914F6CDD1D) & CODE
_A = np.uint64(0x9FB21C651E98DF25)


def bucket_of(word: np.ndarray, n: int) -> np.ndarray:
    return (mix(word ^ _A) >> np.uint64(32)).astype(np.int64) % n


class Heads:
    """Middle words that are split by the word before them (low bits), and into how many parts."""

    def __init__(self, n_buckets: int, words: np.ndarray, parts: np.ndarray):
        o = np.argsort(words)
        self.n, self.words, self.parts = n_buckets, words[o], parts[o]

    def where(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are heads, and the number of the head."""
        at, there = _look(self.words, v)
        return there, at[there]

    def grams(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Buckets of trigrams u v w and contexts u v."""
        b = bucket_of(v, self.n)
        there, at = self.where(v)
        b[there] = bucket_of(v[there] + mix(mix(u[there]) % self.parts[at]), self.n)
        return b

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Buckets of pairs v w of heads v."""
        return bucket_of(pair_hash(v, w), self.n)


def heads_of(docs: DataFrame, n_buckets: int) -> Heads:
    """Words with ``HEAD`` buckets' share of the tokens. A piece reports words from half that share on, so that none is missed."""

    def run(batches):
        n = 0
        for batch in batches:
            raw, at = buffer(batch.column(0))
            for i, j in pieces(at, 1 << 21):
                tok, _ = tokens(raw, at[i : j + 1])
                n += len(tok)
                w, c = np.unique(tok, return_counts=True)
                often = c * n_buckets * 2 >= len(tok) * HEAD
                yield pa.RecordBatch.from_arrays([pa.array(w[often].view(np.int64)), pa.array(c[often].astype(np.int64))], names=["w", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([n], pa.int64())], names=["w", "c"])

    c = cut(docs.select("text").mapInArrow(tidy(run), "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "kn-heads")
    n = c.where("w = -1").agg(F.sum("c")).first()[0] or 0
    t = c.where((F.col("w") >= 0) & (F.col("c") * (2 * n_buckets) >= n * HEAD)).toArrow()  # at most n_buckets * 2 / HEAD
    return Heads(n_buckets, t["w"].to_numpy().astype(np.uint64), -(-t["c"].to_numpy().astype(np.int64) * n_buckets // max(1, n)).astype(np.uint64) + np.uint64(1))


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words and ends of the texts of a piece, and the n + 1 offsets."""
    h, words = word_hashes(raw[at[0] : at[-1]], at - at[0])
    out = np.full(len(h) + len(at) - 1, END, np.uint64)
    n = np.diff(words)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h & CODE
    return out, words + np.arange(len(at))


def before(tok: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each (of the farther one the low bits); texts begin after two ends."""
    v = np.concatenate([[END], tok[:-1]]) if len(tok) else tok
    u = np.concatenate([[END], v[:-1]]) if len(tok) else tok
    u[cuts[:-1]] = END
    return u & NEAR, v


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _runs(train: DataFrame, heads: Heads) -> DataFrame:
    """(bucket, grams: binary): runs of trigrams with counts."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            b = heads.grams(u, v).astype(np.uint32)
            o = np.argsort(b, kind="stable")
            rows = _stretches(b[o])
            u, v, w = u[o], v[o], w[o]
            del b, o
            for k in range(0, len(rows), 8):
                some = rows[k : k + 8]
                out = [encode(*_gathered(u[i:j], v[i:j], w[i:j])) for _, i, j in some]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in some], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "grams"])

        for batch in batches:
            raw, at = buffer(batch.column(0))
            for i, j in pieces(at, 1 << 21):
                tok, cuts = tokens(raw, at[i : j + 1])
                held.append((*before(tok, cuts), tok))
                size += len(tok)
                if size > RUN:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return train.select("text").mapInArrow(tidy(run), "bucket int, grams binary")


def _stretches(b: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each stretch of equal values; buckets that have nothing cost nothing."""
    new = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return list(zip(b[new].tolist(), new.tolist(), [*new[1:].tolist(), len(b)], strict=True)) if len(b) else []


def _gathered(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trigrams with counts, by v, then u. Few bits decide the order, so that one may come twice; the merge is exact."""
    key = (mix(v) >> np.uint64(44) << np.uint64(44)) | (mix(u) >> np.uint64(42) << np.uint64(22)) | (mix(w) >> np.uint64(42))
    o = np.argsort(key)
    u, v, w = u[o], v[o], w[o]
    new = _starts(v, u, w)
    return u[new], v[new], w[new], _sizes(new, len(u))


def _few(x: np.ndarray) -> bytes:
    """Numbers that are mostly small: a byte each, those from 255 on aside."""
    big = np.flatnonzero(x >= 255)
    return b"".join([np.array([len(x), len(big)], "<i8").tobytes(), np.minimum(x, 255).astype(np.uint8).tobytes(), big.astype("<i8").tobytes(), x[big].astype("<i8").tobytes()])


def _narrow(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


class _Reader:
    def __init__(self, body: bytes):
        self.body, self.place = body, 0

    def take(self, kind, n: int) -> np.ndarray:
        x = np.frombuffer(self.body, kind, n, self.place)
        self.place += x.nbytes
        return x

    def few(self) -> np.ndarray:
        n, k = self.take("<i8", 2).tolist()
        x = self.take(np.uint8, n).astype(np.int64)
        big = self.take("<i8", k)
        x[big] = self.take("<i8", k)
        return x

    def wide(self, n: int, width: int) -> np.ndarray:
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = self.take(np.uint8, n * width).reshape(n, width)
        return x.view("<u8").ravel()


def encode(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """Trigrams by v, then u: stretches of v with their numbers of u, those with their numbers of w."""
    context, first = _starts(v, u), _starts(v)
    per = _sizes(np.searchsorted(context, first), len(context))
    return b"".join([np.array([len(first), len(context), len(w)], "<i8").tobytes(), _narrow(v[first], 6), _few(per), _narrow(u[context], 5), _few(_sizes(context, len(w))), _narrow(w, 6), _few(c)])


def decode(body: bytes) -> tuple[np.ndarray, ...]:
    r = _Reader(body)
    a, b, n = r.take("<i8", 3).tolist()
    v = r.wide(a, 6)
    v = np.repeat(v, r.few())
    u = r.wide(b, 5)
    per = r.few()
    return np.repeat(u, per), np.repeat(v, per), r.wide(n, 6), r.few()


def _count(runs: DataFrame, heads: Heads, here: str) -> DataFrame:
    """Merges the runs of each bucket and stores its arrays of counts. One row per bucket: its second words, pairs of heads, counts of counts."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        u, v, w, c = (np.concatenate(x) for x in zip(*[decode(x.as_py()) for x in t["grams"]], strict=True))
        o = np.lexsort((w, u, v))
        u, v, w, c = u[o], v[o], w[o], c[o]
        new = _starts(v, u, w)
        u, v, w, c = u[new], v[new], w[new], np.add.reduceat(c, new)
        three = _often(c)
        _write(f"{here}/tri", bucket, counted(gram_hash(u, v, w), c))
        new = _starts(v, u)
        _write(f"{here}/ctx", bucket, summed(pair_hash(u[new], v[new]), c, new))
        tokens_ = int(c.sum())
        o = np.lexsort((w, v))
        v, w, c = v[o], w[o], c[o]
        new = _starts(v, w)
        kinds, c = _sizes(new, len(v)), np.add.reduceat(c, new)
        v, w = v[new], w[new]
        kinds = np.where(v == END, c, kinds)
        hot, _ = heads.where(v)
        split = _narrow(v[hot], 6), _narrow(w[hot], 6), _few(kinds[hot]), _few(c[hot])
        v, w, kinds, c = v[~hot], w[~hot], kinds[~hot], c[~hot]
        _write(f"{here}/bi", bucket, counted(pair_hash(v, w), kinds))
        new = _starts(v)
        _write(f"{here}/first", bucket, summed(mix(v[new]), kinds, new))
        return pa.table({"bucket": t["bucket"][:1].combine_chunks(), "words": pa.array([_totals(w, c)], pa.binary()), "heads": pa.array([np.array([int(hot.sum())], "<i8").tobytes() + b"".join(split)], pa.binary()), "three": pa.array([three], pa.list_(pa.int64())), "two": pa.array([_often(kinds)], pa.list_(pa.int64())), "n": pa.array([tokens_], pa.int64())})

    return runs.groupBy("bucket").applyInArrow(run, "bucket int, words binary, heads binary, three array<long>, two array<long>, n long")


def _often(c: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


def _totals(w: np.ndarray, c: np.ndarray) -> bytes:
    """Second words of distinct pairs, each with how many pairs it has and the sum of their counts."""
    o = np.argsort(w, kind="stable")
    w, c = w[o], c[o]
    new = _starts(w)
    return b"".join([np.array([len(new)], "<i8").tobytes(), _narrow(w[new], 6), _few(_sizes(new, len(w))), _few(np.add.reduceat(c, new) if len(new) else c)])


def _head_pairs(grams: DataFrame, heads: Heads, here: str) -> DataFrame:
    """Pairs of heads, which meet by both words. One row per bucket, with ``first``: what follows each head once, twice, more often."""

    def deal(batches):
        for batch in batches:
            for x in batch.column(0):
                r = _Reader(x.as_py())
                n = int(r.take("<i8", 1)[0])
                all_ = [r.wide(n, 6).view(np.int64), r.wide(n, 6).view(np.int64), r.few(), r.few()]
                b = heads.pairs(all_[0].view(np.uint64), all_[1].view(np.uint64))
                o = np.argsort(b, kind="stable")
                rows = _stretches(b[o])
                out = [np.concatenate([y[o[i:j]] for y in all_]).tobytes() for _, i, j in rows]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "pairs"])

    def run(t: pa.Table) -> pa.Table:
        v, w, kinds, c = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(4, -1) for x in t["pairs"]], axis=1)
        v, w = v.view(np.uint64), w.view(np.uint64)
        o = np.lexsort((w, v))
        v, w, kinds, c = v[o], w[o], kinds[o], c[o]
        new = _starts(v, w)
        v, w, kinds, c = v[new], w[new], np.add.reduceat(kinds, new), np.add.reduceat(c, new)
        bucket = t["bucket"][0].as_py()
        _write(f"{here}/hbi", bucket, counted(pair_hash(v, w), kinds))
        new = _starts(v)
        first = [{"w": int(x), "n": list(map(int, y))} for x, *y in zip(v[new], *_by_count(kinds, new), strict=True)]
        return pa.table({"bucket": t["bucket"][:1].combine_chunks(), "words": pa.array([_totals(w, c)], pa.binary()), "first": pa.array([first], pa.list_(pa.struct({"w": pa.int64(), "n": pa.list_(pa.int64())}))), "two": pa.array([_often(kinds)], pa.list_(pa.int64())), "n": pa.array([0], pa.int64())})

    dealt = grams.select("heads").mapInArrow(tidy(deal), "bucket int, pairs binary")
    return dealt.groupBy("bucket").applyInArrow(run, "bucket int, words binary, first array<struct<w: long, n: array<long>>>, two array<long>, n long")


def _write(folder: str, bucket: int, body: bytes) -> None:
    """Written aside and renamed: a task that runs again finds all or nothing."""
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{bucket}-{os.uname().nodename}-{os.getpid()}"
    with open(own, "wb") as f:
        f.write(body)
    os.replace(own, f"{folder}/{bucket}")


def _second_words(counted_: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, words): by bucket of the second word, each with its distinct first words and its count."""

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                r = _Reader(x.as_py())
                w = r.wide(int(r.take("<i8", 1)[0]), 6)
                kinds, total = r.few(), r.few()
                b = bucket_of(w, n_buckets)
                o = np.argsort(b, kind="stable")
                w, kinds, total = w[o], kinds[o], total[o]
                rows = _stretches(b[o])
                out = [np.concatenate([w[i:j].view(np.int64), kinds[i:j], total[i:j]]).tobytes() for _, i, j in rows]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "words"])

    return counted_.select("words").mapInArrow(tidy(run), "bucket int, words binary")


def _words(parts: DataFrame) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        x = [np.frombuffer(x.as_py(), np.int64).reshape(3, -1) for x in t["words"]]
        w, kinds, total = np.concatenate(x, axis=1)
        o = np.argsort(w.view(np.uint64), kind="stable")
        w, kinds, total = w[o], kinds[o], total[o]
        new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        w, kinds, total = w[new], np.add.reduceat(kinds, new), np.add.reduceat(total, new)
        return pa.table({"bucket": pa.array(t["bucket"][:1].combine_chunks()), "words": pa.array([np.concatenate([w, kinds, total]).tobytes()], pa.binary()), "counts": pa.array([np.bincount(np.minimum(kinds, 5), minlength=6)[1:5].tolist()], pa.list_(pa.int64())), "n": pa.array([len(w)], pa.int64())})

    return parts.groupBy("bucket").applyInArrow(run, "bucket int, words binary, counts array<long>, n long")


def discounts(n: list[int]) -> list[float]:
    """For counts 1, 2, 3 and more, from the number of things counted once to four times.

    Where a count of counts is 0 the formula has no value; then, and never outside 0 to the count, 0.5, 1 and 1.5 serve.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and b else k / 2
        out.append(d if 0 < d < k else k / 2)
    return out


def _discount(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def gram_hash(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return pair_hash(pair_hash(u, v), w)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0xFF51AFD7ED558CCD) + mix(w))


def _stored(h: np.ndarray, code: np.ndarray, odd: np.ndarray, values: list[np.ndarray]) -> bytes:
    """A sorted array of hashes with a code each; the values of the ``odd`` ones stand aside."""
    o = np.argsort(h)
    h, odd = h[o], np.flatnonzero(odd[o])
    bits = max(1, len(h).bit_length() - 4)
    edge = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u4")
    head = np.array([len(h), bits, code.itemsize, len(odd), len(values)], "<i8")
    return b"".join([head.tobytes(), edge.tobytes(), (h << np.uint64(bits) >> np.uint64(32)).astype("<u4").tobytes(), code[o].tobytes(), odd.astype("<u4").tobytes(), *[v[o][odd].astype("<i8").tobytes() for v in values]])


def counted(h: np.ndarray, c: np.ndarray) -> bytes:
    return _stored(h, np.minimum(c, 255).astype(np.uint8), c >= 255, [c])


#: Least numbers, by count (1, 2, 3 and more) and of what counts have above 3, that do not fit into a context's code.
FIT = 32, 8, 8, 31


def _by_count(c: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """By stretch: how many are 1, 2, 3 and more, and what the last have above 3 each."""
    return [np.add.reduceat(x.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64) for x in (c == 1, c == 2, c >= 3, np.maximum(c - 3, 0))]


def summed(h: np.ndarray, c: np.ndarray, starts: np.ndarray) -> bytes:
    """Contexts: how many things follow them once, twice, more often, and what the last have above 3 each."""
    n = _by_count(c, starts)
    odd = np.zeros(len(h), bool)
    code = np.zeros(len(h), np.int64)
    for x, k in zip(n, FIT, strict=True):
        odd |= x >= k
        code = code * k + np.minimum(x, k - 1)
    return _stored(h, code.astype("<u2"), odd, n)


class Lookup:
    """What ``_stored`` made, mapped from a file."""

    def __init__(self, path: str):
        body = np.memmap(path, np.uint8, "r")
        self.n, self.bits, size, odd, values = np.frombuffer(body, "<i8", 5).tolist()
        place = 40
        parts = []
        for kind, n in (("<u4", (1 << self.bits) + 1), ("<u4", self.n), (f"<u{size}", self.n), ("<u4", odd), *[("<i8", odd)] * values):
            parts.append(np.frombuffer(body, kind, n, place))
            place += parts[-1].nbytes
        self.edge, self.rest, self.code, self.odd, *self.values = parts

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those hashes that are there, and which they are."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        want = (h << np.uint64(self.bits) >> np.uint64(32)).astype(np.uint32)
        low, end = self.edge[slot].astype(np.int64), self.edge[slot + 1].astype(np.int64)
        high = end.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            mid = np.minimum((low + high) >> 1, self.n - 1)
            less = (self.rest[mid] < want) & (low < high)
            high = np.where(less, high, mid.clip(low, high))
            low = np.where(less, mid + 1, low)
        there = np.flatnonzero(low < end)
        there = there[self.rest[low[there]] == want[there]]
        return low[there], there

    def aside(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some places stand aside, and where."""
        if not len(self.odd):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.odd, at), len(self.odd) - 1)
        hit = np.flatnonzero(self.odd[k] == at)
        return hit, k[hit]

    def counts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = self.find(h)
        c = self.code[at].astype(np.int64)
        hit, k = self.aside(at)
        c[hit] = self.values[0][k]
        return c, there

    def sums(self, h: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total and left-over weight of contexts that are there, and which they are."""
        at, there = self.find(h)
        code, n = self.code[at].astype(np.int64), []
        for k in FIT[::-1]:
            n.insert(0, code % k)
            code //= k
        hit, k = self.aside(at)
        for x, values in zip(n, self.values, strict=True):
            x[hit] = values[k]
        return *_left(n, d), there


def _left(n: list[np.ndarray], d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Total and left-over weight of contexts, of numbers as ``_by_count`` gives them."""
    total = n[0] + 2 * n[1] + 3 * n[2] + n[3]
    return total, (n[0] * d[0] + n[1] * d[1] + n[2] * d[2]) / total


class Model:
    """What scores a bucket's tokens: sorted arrays, mapped from files."""

    def __init__(self, totals: dict, folder: str):
        self.folder, self.files = folder, {}
        self.has = {k: np.unpackbits(np.frombuffer(totals[k], np.uint8)) for k in ("grams", "hbi", "words")}

    def _open(self, name: str, bucket: int, kind):
        if (name, bucket) not in self.files:
            if len(self.files) >= OPEN:
                self.files.clear()
            self.files[name, bucket] = kind(f"{self.folder}/{name}/{bucket}")
        return self.files[name, bucket]

    def look(self, name: str, bucket: int) -> Lookup | None:
        return self._open(name, bucket, Lookup) if self.has["hbi" if name == "hbi" else "grams"][bucket] else None

    def words(self, bucket: int) -> np.ndarray:
        return self._open("words", bucket, lambda p: np.memmap(p, np.uint8, "r")) if self.has["words"][bucket] else np.zeros(0, np.uint8)


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among the sorted ones, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _local(spark: SparkSession, path: str) -> str:
    """``path`` as the executors' file systems have it; an error if Hadoop resolves it to another store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    if uri.getScheme() != "file":
        raise ValueError(f"the model's sorted arrays are mapped from {path}, which is no folder that executors can mount ({uri.getScheme()})")
    return uri.getPath()


def train(docs: DataFrame, n_buckets: int | None = None) -> tuple[dict, str]:
    """Counts the rows of ``docs`` and stores the model; returns its totals and its folder in the shared one."""
    if n_buckets is None:  # BUCKETS times a power of two
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        n_buckets = BUCKETS << max(0, -(-size // (BUCKETS * BUCKET_BYTES)) - 1).bit_length()
    spark = docs.sparkSession
    here = _local(spark, scratch_path(spark, "kn"))
    heads = heads_of(docs, n_buckets)
    grams = cut(_count(_runs(docs, heads), heads, here), "kn-grams")
    split = cut(_head_pairs(grams, heads, here), "kn-heads") if len(heads.words) else None
    both = grams.select("words", "two", "n") if split is None else grams.select("words", "two", "n").unionByName(split.select("words", "two", "n"))
    words = cut(_words(_second_words(both, n_buckets)), "kn-words")
    add = lambda df, name: [x or 0 for x in df.agg(*[F.sum(F.col(name)[k]) for k in range(4)], F.sum("n")).first()]
    *three, n_tokens = add(grams, "three")
    *two, _ = add(both, "two")
    *one, v = add(words, "counts")
    d1 = discounts(one)
    kinds = words.select("words")

    def sums(batches):  # distinct pairs, and the discounts taken, by the distinct first words of a word
        for batch in batches:
            n, taken = 0, 0.0
            for x in batch.column(0):
                _, k, _ = np.frombuffer(x.as_py(), np.int64).reshape(3, -1)
                n, taken = n + int(k.sum()), taken + float(np.minimum(_discount(k, d1), k).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([taken])], names=["n", "taken"])

    s = kinds.mapInArrow(tidy(sums), "n long, taken double").agg(F.sum("n").alias("n"), F.sum("taken").alias("taken")).first()
    n = s["n"] or 0
    totals = {"tokens": n_tokens, "words_known": v, "pairs": n, "unknown": (s["taken"] or 0.0) / n / (v + 1) if n else 1.0, "buckets": n_buckets, "d3": discounts(three), "d2": discounts(two), "heads": heads, "first": np.zeros((4, len(heads.words)), np.int64)}
    if split is not None:  # a row for each head
        first = split.select(F.explode("first").alias("f")).groupBy("f.w").agg(*[F.sum(F.col("f.n")[k]).alias(f"n{k}") for k in range(4)]).toArrow()
        at, _ = _look(heads.words, first["w"].to_numpy().astype(np.uint64))
        totals["first"][:, at] = [first[f"n{k}"].to_numpy() for k in range(4)]

    def store(batches):
        for batch in batches:
            for key, w in zip(*batch.columns, strict=True):
                h, k, c = np.frombuffer(w.as_py(), np.int64).reshape(3, -1)
                p1 = (np.maximum(k - _discount(k, d1), 0) / n + totals["unknown"]).astype("<f4")
                _write(f"{here}/words", key.as_py(), h.tobytes() + p1.tobytes() + c.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["bucket"])

    made = {"grams": grams.select("bucket"), "hbi": grams.select("bucket").limit(0) if split is None else split.select("bucket"), "words": words.select("bucket", "words").mapInArrow(tidy(store), "bucket int")}
    for name, df in made.items():
        there = np.zeros(n_buckets, np.uint8)
        there[df.toArrow()["bucket"].to_numpy()] = 1  # a number for each bucket
        totals[name] = np.packbits(there).tobytes()
    return totals, here


def scores(docs: DataFrame, totals: dict, folder: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id if not given), n_tokens, n_known, base_score, score: log10 probabilities of whole texts.

    Tokens of a piece of a batch are looked up bucket by bucket, in sorted arrays that workers map.
    """
    keep = keep or ["doc_id"]

    def run(batches):
        model, nb = Model(totals, folder), totals["buckets"]
        n, v = totals["tokens"], totals["words_known"]
        none = np.log10(0.5 / (n + 0.5 * (v + 1)))
        for batch in batches:
            raw, at = buffer(batch.column(0))
            out = [np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)]
            for i, j in pieces(at, 1 << 21):
                tok, cuts = tokens(raw, at[i : j + 1])
                u, prev = before(tok, cuts)
                # distinct words first, each looked up once in a piece
                kinds, which = np.unique(tok, return_inverse=True)
                p1, base, known = np.full(len(kinds), totals["unknown"]), np.full(len(kinds), none), np.zeros(len(kinds), bool)
                rest = np.ones(len(kinds))  # of contexts of one word
                after = np.ones(len(kinds))
                b = bucket_of(kinds, nb)
                for k, some in _groups(b, np.argsort(b, kind="stable")):
                    w = model.words(k)
                    m = len(w) // 20
                    x, there = _look(w[: 8 * m].view(np.uint64), kinds[some])
                    some_, x = some[there], x[there]
                    p1[some_] = w[8 * m : 12 * m].view("<f4")[x]
                    base[some_] = np.log10((w[12 * m :].copy().view("<u8")[x] + 0.5) / (n + 0.5 * (v + 1)))
                    known[some_] = True
                    if table_ := model.look("first", k):
                        total, left, there = table_.sums(mix(kinds[some]), totals["d2"])
                        after[some[there]], rest[some[there]] = total, left
                heads = totals["heads"]
                there, at_ = heads.where(kinds)
                after[there], rest[there] = _left(list(totals["first"][:, at_]), totals["d2"])
                first = np.searchsorted(kinds, prev)
                p = rest[first] * p1[which]
                three, two, context = gram_hash(u, prev, tok), pair_hash(prev, tok), pair_hash(u, prev)

                def add_pairs(name, k, some):
                    c, there = model.look(name, k).counts(two[some])
                    some = some[there]
                    p[some] += np.maximum(c - _discount(c, totals["d2"]), 0) / after[first[some]]

                hot, _ = heads.where(prev)
                bt = b[first]
                for k, some in _groups(bt, np.argsort(bt, kind="stable")):
                    if model.has["grams"][k]:
                        add_pairs("bi", k, some)
                hot = np.flatnonzero(hot)
                bt = heads.pairs(prev[hot], tok[hot])
                for k, some in _groups(bt, np.argsort(bt, kind="stable")):
                    if model.has["hbi"][k]:
                        add_pairs("hbi", k, hot[some])
                bt = heads.grams(u, prev)
                for k, some in _groups(bt, np.argsort(bt, kind="stable")):
                    if not model.has["grams"][k]:
                        continue
                    total, left, there = model.look("ctx", k).sums(context[some], totals["d3"])
                    p[some[there]] *= left
                    all_ = np.ones(len(some))
                    all_[there] = total
                    c, there = model.look("tri", k).counts(three[some])
                    p[some[there]] += np.maximum(c - _discount(c, totals["d3"]), 0) / all_[there]
                logs = np.log10(p)
                at_ = cuts[:-1]
                out[0][i:j] = np.diff(cuts)
                for q, x in ((1, known[which].astype(np.int64)), (2, base[which]), (3, logs)):
                    out[q][i:j] = np.add.reduceat(x, at_)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, out)], names=[*batch.schema.names[1:], "n_tokens", "n_known", "base_score", "score"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(tidy(run), f"{types}, n_tokens long, n_known long, base_score double, score double")


def _groups(b: np.ndarray, order: np.ndarray):
    for k, i, j in _stretches(b[order]):
        yield k, order[i:j]


def language_model(docs: DataFrame) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 5) == 1
    totals, folder = train(docs.where(~held))
    return scores(docs, totals, folder).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents"))
