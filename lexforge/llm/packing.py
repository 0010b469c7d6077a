"""Op 9, best-fit packing: sum-of-squares packing of tokenised documents into sequences.

Every document becomes its token ids and the id 1; only one longer than a sequence is cut, into pieces of
a whole sequence and a rest. Pieces are dealt by a hash of their identity into groups of some ``GROUP``
pieces, whatever their source, so no key can make a group large. In a group the pieces go by falling length;
each goes to the open bin, or a new one, that leaves the sum over residual gaps of the squared number of
open bins with that gap smallest (ties: the smaller gap). Bins of one gap are alike, so the state is one
count per gap. A group leaves at most a few bins open, a share of GROUP ** -1 of all.

Defined results: a null or empty text is the single id 1; repeated rows with one doc_id are packed each for
itself, as are equal pieces; without rows there are no sequences. A very long text is cut into pieces,
each packed for itself. Reruns agree. Of other columns only those asked for as keys are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer, cut, kept, mix, pieces, table, tidy

LENGTH = 4096
END = 1
#: Pieces in a group, about. A group's state and rows are some 60 bytes a piece.
GROUP = 20_000
#: Distinct parts of words whose ids a worker keeps, some 45 bytes each; beyond it forgets those that came last, which changes no result.
PARTS = 1_000_000
#: Most bytes of a part that the table takes, and bytes of text that a worker goes through at a time.
WIDE = 24
CHUNK = 1 << 18


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Token ids of many texts at a time.

    The vocabulary lower-cases, cuts at white space, and in between into runs of letters, single digits and runs of other
    characters, each tokenised for itself. Where a word (a run without ASCII white space) has only ASCII and letters up to U+00FF, its
    parts are cut here, by a table of byte classes, and the ids of each distinct part are learnt once. A part of at most ``WIDE`` bytes
    is its own key (three 64-bit numbers, so that a match is exact), in an open hash table of NumPy arrays: some 45 bytes a part, of
    which at most ``PARTS`` are kept. All other words, and those that hold a special token or an apostrophe, go whole and as they
    are to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # for words that are lower-case letters already
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind = np.dtype(np.uint16 if len(self.last) <= 1 << 16 else np.uint32)
        self.whole: dict[bytes, bytes] = {}
        self.slots = np.full(1 << 16, -1, np.int32)
        self.n = self.used = 0
        self.keys, self.at, self.size, self.arena = np.zeros((1 << 15, 3), np.uint64), np.zeros(1 << 15, np.uint32), np.zeros(1 << 15, np.uint16), np.zeros(1 << 17, self.kind)

    # ---- the table of parts

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys[:, 0] + mix(keys[:, 1] + mix(keys[:, 2])))

    def _find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each part, or -1."""
        mask = len(self.slots) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        out = self.slots[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys).any(axis=1))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            found = self.slots[slot[left]]
            out[left] = found
            left = left[(found >= 0) & (self.keys[found] != keys[left]).any(axis=1)]
        return out

    def _place(self, first: int) -> None:
        """Enters the parts from ``first`` on into the slots."""
        mask = len(self.slots) - 1
        left = np.arange(first, self.n, dtype=np.int32)
        slot = (self._hash(self.keys[first : self.n]) & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of several for one slot the last one stays
            there = self.slots[slot] == left
            left, slot = left[~there], (slot[~there] + 1) & mask

    def _room(self, parts: int, ids: int) -> None:
        for name, used, more in (("keys", self.n, parts), ("at", self.n, parts), ("size", self.n, parts), ("arena", self.used, ids)):
            x = getattr(self, name)
            if used + more > len(x):
                new = np.zeros((max(used + more, len(x) * 3 // 2), *x.shape[1:]), x.dtype)
                new[:used] = x[:used]
                setattr(self, name, new)
        if 2 * (self.n + parts) > len(self.slots):
            self.slots = np.full(1 << (2 * (self.n + parts) - 1).bit_length(), -1, np.int32)
            self._place(0)

    def _learn(self, keys: np.ndarray, h: np.ndarray) -> None:
        """Adds parts that are new. Of parts with equal hashes one is added; the caller looks again."""
        keys = keys[np.unique(h, return_index=True)[1]]
        if self.n + len(keys) > PARTS:  # forgets those that came last: the first that came are the most frequent; no result changes
            self.n = min(self.n, PARTS // 2)
            self.used = int(self.at[self.n - 1]) + int(self.size[self.n - 1]) if self.n else 0
            self.slots[:] = -1
            self._place(0)
        words = np.ascontiguousarray(keys).view(f"S{WIDE}").ravel().tolist()
        letters = np.array([w[0] >= 97 and w[0] not in b"{|}~\x7f" for w in words])
        keys = np.concatenate([keys[letters], keys[~letters]])
        plain = [w.decode() for w, ok in zip(words, letters, strict=True) if ok]
        ids, size = [], []
        for i in range(0, len(plain), 1024):
            some = np.array(self.bare.encode_batch_fast([" ".join(plain[i : i + 1024])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[some]) + 1
            if len(ends) != len(plain[i : i + 1024]):
                raise ValueError("the vocabulary does not mark the ends of words")
            ids.append(some)
            size.append(np.diff(ends, prepend=0))
        rest = self.tokenizer.encode_batch_fast([w.decode() for w, ok in zip(words, letters, strict=True) if not ok], add_special_tokens=False)
        ids += [np.array(e.ids, self.kind) for e in rest]
        size.append(np.array([len(e.ids) for e in rest], np.int64))
        ids, size = np.concatenate(ids), np.concatenate(size)
        self._room(len(keys), len(ids))
        n, self.n, used, self.used = self.n, self.n + len(keys), self.used, self.used + len(ids)
        self.keys[n : self.n], self.size[n : self.n], self.arena[used : self.used] = keys, size, ids
        self.at[n : self.n] = used + np.cumsum(size) - size
        self._place(n)

    def _whole(self, words: list[bytes]) -> list[bytes]:
        new = [w for w in dict.fromkeys(words) if w not in self.whole]
        if len(self.whole) + len(new) > PARTS // 8:
            self.whole.clear()
            new = list(dict.fromkeys(words))
        found = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        self.whole.update(zip(new, [np.array(e.ids, self.kind).tobytes() for e in found], strict=True))
        return [self.whole[w] for w in words]

    # ---- texts

    def chunk(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each part or whole word of some bytes begins, how many ids it has, and all ids. ``edges``: where texts begin in it."""
        kind, low = _CLASS[raw], _SMALL[raw]
        inner = kind != 0
        begins = inner.copy()
        begins[1:] &= ~inner[:-1]
        begins[edges] = inner[edges]
        odd = kind == 4
        lead = np.flatnonzero(raw == 0xC3)
        if len(lead):  # two-byte letters; their second byte has the class of a letter, others are odd
            second = low[lead + 1]
            odd[lead[(second == 0x97) | (second == 0xB7)]] = True
            low[lead + 1] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 0x20, second)
        follow = np.flatnonzero((raw >= 0x80) & (raw < 0xC0))
        if len(follow):
            odd[follow[raw[follow - 1] != 0xC3]] = True
        body = raw.tobytes()
        for token in self.special:
            k = body.find(token)
            while k >= 0:
                odd[k] = True
                k = body.find(token, k + 1)
        part = inner & (kind == 3)
        part[1:] |= inner[1:] & (kind[1:] != kind[:-1])
        part |= begins
        start = np.flatnonzero(part)
        stop = np.append(start[1:], len(raw))
        # a part ends at white space
        word = np.cumsum(begins)[start] - 1
        first = np.flatnonzero(begins)
        over = inner[:-1] & ~inner[1:]
        over[edges[edges > 0] - 1] = inner[edges[edges > 0] - 1]  # of the last byte before a text
        ends = np.flatnonzero(np.append(over, inner[-1:])) + 1
        stop = np.minimum(stop, ends[word]) if len(start) else stop[:0]
        length = stop - start
        bad = np.zeros(len(first), bool)
        if odd.any():
            bad[np.searchsorted(first, np.flatnonzero(odd), side="right") - 1] = True
        bad[word[length > WIDE]] = True
        keep = ~bad[word]
        start, length = start[keep], length[keep]
        whole = np.flatnonzero(bad)
        # keys: 8 bytes each at the start and 8 and 16 bytes further, what lies beyond the part masked
        view = np.ndarray(len(low) + 1, np.dtype("<u8"), np.concatenate([low, np.zeros(WIDE + 8, np.uint8)]).tobytes(), strides=(1,)) if len(start) else None
        keys = np.zeros((len(start), 3), np.uint64)
        for k in range(3):
            some = np.flatnonzero(length > 8 * k) if k else slice(None)
            if k and not len(some):
                break
            n = np.minimum(length[some] - 8 * k, 8)
            if view is not None:
                keys[some, k] = view[np.minimum(start[some] + 8 * k, len(low))] & _MASK[n]
        h = self._hash(keys)
        number = self._find(keys, h)
        new = np.flatnonzero(number < 0)
        while len(new):
            before = self.n
            self._learn(keys[new], h[new])
            if self.n <= before:  # some were forgotten
                number = self._find(keys, h)
                new = np.flatnonzero(number < 0)
            else:
                number[new] = self._find(keys[new], h[new])
                new = new[number[new] < 0]
        size, at = self.size[number].astype(np.int64), self.at[number].astype(np.int64)
        source = self.arena
        if len(whole):
            words = self._whole([body[a:b] for a, b in zip(first[whole].tolist(), ends[whole].tolist(), strict=True)])
            more = np.array([len(w) for w in words]) // self.kind.itemsize
            source = np.concatenate([self.arena[: self.used], np.frombuffer(b"".join(words), self.kind)])
            start, size, at = np.concatenate([start, first[whole]]), np.concatenate([size, more]), np.concatenate([at, self.used + np.cumsum(more) - more])
            o = np.argsort(start)
            start, size, at = start[o], size[o], at[o]
        begin = np.cumsum(size) - size
        return start, size, source[np.repeat(at - begin, size) + np.arange(int(size.sum()))]

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each with ``END`` behind, and the n + 1 offsets. Goes through ``CHUNK`` bytes at a time, cut at white space."""
        n, found = np.zeros(len(at) - 1, np.int64), []
        place, last = int(at[0]), int(at[-1])
        while place < last:
            stop = _cut(raw, at, place, last)
            i, j = np.searchsorted(at, place, side="right"), np.searchsorted(at, stop)
            start, size, ids = self.chunk(raw[place:stop], at[i:j] - place)
            text = np.searchsorted(at, start + place, side="right") - 1
            n += np.bincount(text, size, len(n)).astype(np.int64)
            found.append(ids)
            place = stop
        cuts = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.full(int(cuts[-1]), END, "<u4")
        inside = np.ones(len(out), bool)
        inside[cuts[1:] - 1] = False
        out[inside] = np.concatenate(found) if found else 0
        return out, cuts


def _cut(raw: np.ndarray, at: np.ndarray, place: int, last: int) -> int:
    """Where the bytes from ``place`` on may be cut: after white space or a text; a run without either is never cut."""
    stop = place + CHUNK
    if stop >= last:
        return last
    edge = int(at[np.searchsorted(at, stop, side="right") - 1])
    if edge > place and stop - edge < CHUNK // 2:
        return edge
    step = 1 << 12
    while stop < last:
        some = raw[stop : min(stop + step, last)]
        space = np.flatnonzero((some == 32) | ((some >= 9) & (some <= 13)))
        edge = int(at[np.searchsorted(at, stop)])
        if len(space) and stop + int(space[0]) < edge:
            return stop + int(space[0]) + 1
        if edge <= stop + len(some):
            return edge
        stop += step
    return last


#: By byte: 0 white space, 1 part of a letter, 2 other ASCII, 3 digit, 4 what only the tokenizer itself can judge (and NUL, which ends keys).
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
_CLASS[48:58] = 3
_CLASS[[0, 39, 0xC0, 0xC1, 0xC2, *range(0xC4, 256)]] = 4
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


_words: dict[str, Words] = kept.setdefault("packing", {})


def words_of(path: str) -> Words:
    """One cache in each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def tokenised(docs: DataFrame, path: str, keep: list[str], length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``keep``, piece, start, length, ids_crc32, and ids as bytes if asked for."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        words = words_of(path)
        for batch in batches:
            raw, at = buffer(batch.column(0))
            for i, j in pieces(at, 1 << 21):
                ids, cuts = words.ids(raw, at[i : j + 1])
                n = -(-np.diff(cuts) // length)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                a = cuts[row] + piece * length
                b = np.minimum(a + length, cuts[row + 1])
                body = memoryview(ids).cast("B")
                spans = list(zip((4 * a).tolist(), (4 * b).tolist(), strict=True))
                crc = [zlib.crc32(body[p:q]) for p, q in spans]
                take = pa.array(row + i)
                columns = [c.take(take) for c in batch.columns[1:]] + [pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(b - a), pa.array(crc, pa.int64())]
                columns += [pa.array([body[p:q].tobytes() for p, q in spans], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(tidy(run, "packing"), f"{kinds}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and place of each piece, in the order given, and the number of bins."""
    open_ = np.zeros(capacity + 1, np.int64)  # bins by gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i, n in enumerate(lengths.tolist()):
        if n >= capacity:
            out[i], made = made, made + 1
            continue
        # moving a bin from gap g to g - n changes the sum by 2 (N[g - n] - N[g]) + 2, but for gap 0, which doesn't count
        gain = np.where(open_[n:capacity] > 0, -open_[n:capacity], capacity * 1_000_000)
        gain[1:] += open_[1 : capacity - n]
        # each change is 2 * gain + 2, but for a bin that becomes full 2 * gain + 1 and for a new one 2 * N + 1
        gain *= 2
        gain += 2
        gain[0] -= 1
        g = int(gain.argmin())
        if gain[g] <= 2 * open_[capacity - n] + 1:
            g += n
            b = bins[g].pop()
            open_[g] -= 1
        else:
            g, b, made = capacity, made, made + 1
        out[i], place[i] = b, capacity - g
        if g > n:
            open_[g - n] += 1
            bins[g - n].append(b)
    return out, place, made


def pack(pieces: DataFrame, keep: list[str], capacity: int = LENGTH) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``keep`` and piece say which piece a row is."""
    identity = F.xxhash64(*keep, "piece", "length", "ids_crc32")
    n = pieces.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // GROUP))
    # pieces of a whole sequence need no partner; they are dealt too, so that sequence numbers come from one place
    dealt = pieces.withColumn("_group", F.pmod(identity, F.lit(groups)).cast("int"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    names = pieces.columns

    def run(t: pa.Table) -> pa.Table:
        group = t["_group"][0].as_py()
        order = [("length", "descending")] + [(c, "ascending") for c in [*keep, "piece", "ids_crc32"]]
        t = t.select(names).sort_by(order)
        bin_, place, _ = sum_of_squares(t["length"].to_numpy(), capacity)
        return t.append_column("sequence_id", pa.array((group << 32) + bin_)).append_column("offset", pa.array(place))

    return dealt.groupBy("_group").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    return pack(cut(tokenised(docs, path or vocabulary(), keep), "pieces"), keep)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), ["doc_id"])
