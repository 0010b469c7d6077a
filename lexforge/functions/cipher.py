"""Text ciphers: a seeded polyalphabetic substitution over the displayable characters up to U+024F, and ChaCha20.

A character outside of the alphabet stays as it is and uses up a place of the key. With ``key_length`` 0 the key is as long as
the text: its first 10,000 places, then the same stream from its start; each text is enciphered from a fresh key, so that
results depend neither on order nor on partitions. Keys come from the seed, on the driver; a worker that meets a text longer
than all before draws more of the same stream.

``key_length`` 1 is one substitution and is done by ``translate`` in the JVM. Other keys go through Arrow batches in NumPy:
all characters of a batch at once, which is faster than a lambda for each character.
"""

from __future__ import annotations

import base64
import random
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LAST = 0x24F
HIDDEN = ("Cc", "Cf", "Cs", "Co", "Cn")
FRESH = 10_000  # places of the key before the stream starts again, with key_length 0


@lru_cache
def symbols(seed: int | None, last: int = LAST) -> tuple[str, ...]:
    """The alphabet in its seeded order."""
    every = [c for c in map(chr, range(last + 1)) if unicodedata.category(c) not in HIDDEN]
    random.Random(seed).shuffle(every)
    return tuple(every)


@lru_cache
def shifts(seed: int | None, n: int, last: int = LAST) -> np.ndarray:
    """The first n places of the key, as shifts; drawn in parts, which is the same stream without a list of n numbers."""
    size, r = len(symbols(seed, last)), random.Random(seed)
    out = np.empty(n, np.int32)
    for i in range(0, n, FRESH):
        out[i : i + FRESH] = r.choices(range(size), k=min(FRESH, n - i))
    return out


@lru_cache(maxsize=16)
def repeated(seed: int | None, key_length: int, n: int, last: int = LAST) -> np.ndarray:
    """The shifts of places 0 to n - 1 of a text."""
    if key_length:
        return np.resize(shifts(seed, key_length, last), n)
    return np.concatenate([shifts(seed, FRESH, last), shifts(seed, max(0, n - FRESH), last)])[:n]


def key_of(seed: int | None, key_length: int, place: np.ndarray, last: int = LAST) -> np.ndarray:
    """The shifts of these places of a text."""
    n = 1 << max(16, int(place.max(initial=0)).bit_length())  # few different lengths, so that the cache serves
    if key_length and n > 1 << 20:
        return shifts(seed, key_length, last)[place % key_length]
    return repeated(seed, key_length, n, last)[place]


def key_at(seed: int | None, key_length: int, n: int, last: int = LAST) -> np.ndarray:
    """The shifts of places 0 to n - 1 of a text."""
    return key_of(seed, key_length, np.arange(n), last)


#: Bytes of text that ``shifted`` takes at a time: its arrays take some 60 bytes for each.
PIECE = 1 << 18


def shifted(texts: pa.Array, seed: int | None, key_length: int, sign: int = 1, last: int = LAST) -> pa.Array:
    """All texts of an Arrow array, en- (sign 1) or deciphered (-1)."""
    order = symbols(seed, last)
    sym = np.array([ord(c) for c in order], np.uint32)
    place = np.full(last + 2, -1, np.int32)  # the last one stands for all other characters
    place[sym] = np.arange(len(sym))
    turned = np.concatenate([sym, sym]) if sign > 0 else np.concatenate([sym, sym])[::-1].copy()  # by the sum of place and shift
    if sign < 0:
        place = np.where(place < 0, -1, len(sym) - 1 - place).astype(np.int32)
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    at = at - at[0]
    ends, bodies, done, base, p = np.zeros(len(at), np.int64), [], 0, 0, 0  # done: characters of the text that a piece goes on with
    while p < len(raw):
        q = min(p + PIECE, len(raw))
        while p < q < len(raw) and raw[q] & 0xC0 == 0x80:  # no character is cut
            q -= 1
        q = q if q > p else len(raw)
        part = raw[p:q]
        code = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        lo, hi = np.searchsorted(at, (p, q))
        begin = np.searchsorted(np.flatnonzero((part & 0xC0) != 0x80), at[lo:hi] - p)  # of each text that begins here, in characters
        index = np.arange(len(code)) - np.repeat(np.concatenate([[-done], begin]), np.diff(np.concatenate([[0], begin, [len(code)]])))
        at_sym = place[np.minimum(code, last + 1)]
        code = np.where(at_sym < 0, code, turned[at_sym + key_of(seed, key_length, index, last)])
        body = code.tobytes().decode("utf-32-le").encode()
        starts = np.flatnonzero((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)  # of each character, in bytes
        ends[lo:hi] = base + np.append(starts, len(body))[begin]
        bodies.append(body)
        done = len(code) - int(begin[-1]) if len(begin) else done + len(code)
        base, p = base + len(bodies[-1]), q
    ends[np.searchsorted(at, len(raw)) :] = base
    body = b"".join(bodies)
    mask = texts.is_valid().cast(pa.uint8()).to_numpy(zero_copy_only=False).astype(bool)
    bits = pa.py_buffer(np.packbits(mask, bitorder="little").tobytes()) if not mask.all() else None
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.tobytes()), pa.py_buffer(body), bits).cast(pa.string())


def poly(text: Column, key_length: int = 0, seed: int | None = 1234, last: int = LAST) -> Column:
    """``text`` enciphered; null stays null."""
    if key_length == 1 and last == LAST:
        order, k = symbols(seed), int(shifts(seed, 1)[0])
        return F.translate(text, "".join(order), "".join(order[(i + k) % len(order)] for i in range(len(order))))
    return _poly(text, key_length, seed, 1, last)


def unpoly(text: Column, key_length: int = 0, seed: int | None = 1234, last: int = LAST) -> Column:
    """The text that ``poly`` enciphered."""
    return _poly(text, key_length, seed, -1, last)


def _poly(text: Column, key_length: int, seed: int | None, sign: int, last: int) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return shifted(texts, seed, key_length, sign, last)

    return run(text)


# ---- ChaCha20 (public algorithm; 64-bit nonce and counter) -------------------------------------------


def seeded_bytes(seed: int, n: int) -> bytes:
    """Drawn anew from the seed at each call, so a nonce is the start of a key of the same seed."""
    r = random.Random(seed)
    return bytes(r.getrandbits(8) for _ in range(n))


def keystream(key: bytes, nonce: bytes, n: int) -> np.ndarray:
    """The first n bytes; all blocks side by side."""
    blocks = -(-n // 64)
    state = np.zeros((16, blocks), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4:12] = np.frombuffer(key, "<u4")[:, None]
    count = np.arange(blocks, dtype=np.uint64)
    state[12], state[13] = count.astype(np.uint32), (count >> np.uint64(32)).astype(np.uint32)
    state[14:] = np.frombuffer(nonce, "<u4")[:, None]
    x = state.copy()
    rows = np.arange(16).reshape(4, 4)
    columns = [tuple(rows[:, i]) for i in range(4)]
    diagonals = [tuple(rows[j, (i + j) % 4] for j in range(4)) for i in range(4)]

    def mix(a, b, c, d):
        for p, q, r, bits in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[p] += x[q]
            y = x[r] ^ x[p]
            x[r] = (y << np.uint32(bits)) | (y >> np.uint32(32 - bits))

    for _ in range(10):
        for quarter in columns + diagonals:
            mix(*quarter)
    return (x + state).T.astype("<u4").tobytes()[:n] if n else b""


def chacha20(text: Column, key: bytes, nonce: bytes) -> Column:
    """Base64 of the enciphered UTF-8 bytes, on one line; every text starts the stream anew."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        raw = [t.encode() if t is not None else None for t in texts.to_pylist()]
        stream = np.frombuffer(keystream(key, nonce, max((len(r) for r in raw if r), default=0)), np.uint8)
        return pa.array([None if r is None else base64.b64encode((np.frombuffer(r, np.uint8) ^ stream[: len(r)]).tobytes()).decode() for r in raw], pa.string())

    return run(text)


#: Ciphers by name: functions of a text column, a seed and a key length (ChaCha20 has none), that encipher it.
CIPHERS = {
    "poly": lambda text, seed=1234, key_length=0: poly(text, key_length, seed),
    "mono": lambda text, seed=1234, key_length=1: poly(text, 1, seed),
    "chacha20": lambda text, seed=1234, key_length=0: chacha20(text, seeded_bytes(seed, 32), seeded_bytes(seed, 8)),
    "none": lambda text, seed=1234, key_length=0: text,
}


def encipher(name: str, text: Column, seed: int = 1234, key_length: int = 0) -> Column:
    if name not in CIPHERS:
        raise ValueError(f"no cipher {name!r}; there are {', '.join(CIPHERS)}")
    return CIPHERS[name](text, seed, key_length)
