"""Statistics for vocabularies, tokenisation, packing, blending and rendering of training data."""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..shared import carried, cut

#: Special tokens by id.
SPECIAL = ("<unk>", "<s>", "</s>", "<pad>", "<CLS>", "<SEP>", "<EOD>", "<MASK>", "\n")
EOD = SPECIAL.index("<EOD>")
UNKNOWN = SPECIAL.index("<unk>")


def char_frequency(docs: DataFrame) -> DataFrame:
    """ch, n. Tasks count before rows move: as many as characters differ."""
    return docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Values of bytes: the elements of ``data`` between the ``offsets``."""
    at = (offsets * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _elements(values: pa.Array, kind: str) -> np.ndarray:
    """What all rows of a binary column hold, end to end."""
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else [0, 0]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind)


#: Bytes of words that ``word_frequency`` counts at once.
COUNTED = 64 << 20
#: Parts, by hash, of all words: one is summed at a time.
PARTS = 4096
#: Most tasks whose greatest counts one task, or the driver, takes.
FAN = 16


def word_frequency(docs: DataFrame, most: int = 0) -> DataFrame:
    """word, n; with ``most``, a task may leave out words that so many others of its own precede by n, or by word at equal n, and at most ``FAN`` tasks have rows.

    Arrow counts the words of ``COUNTED`` bytes of text at a time and sums the counts of each part. The JVM moves a part's words and counts as bytes, not as rows.
    """

    def counts(held):
        n = pc.value_counts(pa.chunked_array(held))
        words, n = n.field("values"), n.field("counts")
        part = np.concatenate([np.fromiter(map(crc32, words[i : i + 65_536].cast(pa.binary()).to_pylist()), np.int64) for i in range(0, len(words), 65_536)]) % PARTS
        order = np.argsort(part, kind="stable")
        return bytes_of(part[order], words.take(pa.array(order)), n.to_numpy()[order])

    def bytes_of(part, words, n):
        parts, first = np.unique(part, return_index=True)
        first, at = np.append(first, len(n)), np.frombuffer(words.buffers()[1], np.int32)[: len(n) + 1]
        data = _binary(at[first], np.frombuffer(words.buffers()[2], np.uint8))
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), _binary(first, np.diff(at)), data, _binary(first, n)], names=["part", "lengths", "words", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            words = t.words_of(batch.column(0)).flatten()
            if len(words):
                held.append(words)
                size += words.nbytes
            if size >= COUNTED:
                yield counts(held)
                held, size = [], 0
        if held:
            yield counts(held)

    def unpacked(rows):
        at = np.concatenate([[0], np.cumsum(_elements(rows.column(1), "<i4"), dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(_elements(rows.column(2), "u1"))])
        return pa.table({"word": words, "n": _elements(rows.column(3), "<i8").copy()})

    def summed(tables):
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def greatest(tables):
        whole = pa.concat_tables(tables)
        if len(whole) > most:
            n = whole["n"].to_numpy()
            whole = whole.filter(pa.array(n >= np.partition(n, -most)[-most]))
        if len(whole) > 2 * most:  # equal counts
            whole = whole.take(pc.select_k_unstable(whole, most, [("n", "descending"), ("word", "ascending")]))
        return whole

    def sums(batches):
        held, size = [], 0
        for batch in batches:
            part = batch.column(0).to_numpy()
            i = int(np.searchsorted(part, part[-1])) if len(part) else 0
            if i:  # all parts but the batch's last are whole
                yield summed([*held, unpacked(batch.slice(0, i))])
                held, size = [], 0
            held.append(unpacked(batch.slice(i)))
            size += held[-1].nbytes
            if size >= COUNTED:
                held, size = [summed(held)], 0
        if held:
            yield summed(held)

    def every(batches):
        for table in sums(batches):
            yield from table.cast(shape).to_batches()

    def chosen(tables):
        held = []
        for table in tables:
            held.append(table)
            if sum(map(len, held)) > 4 * most:
                held = [greatest(held)]
        return greatest(held).cast(shape).combine_chunks() if held else shape.empty_table()

    def row(top):
        """All that a task has chosen as one row."""
        if len(top):
            words = pa.concat_arrays([*top["word"].chunks, pa.array([], pa.string())])
            yield bytes_of(np.full(len(words), TaskContext.get().partitionId()), words, top["n"].to_numpy())

    def rows(batches):
        return (unpacked(batch.slice(i, 1)) for batch in batches for i in range(len(batch)))

    def first(batches):
        yield from row(chosen(sums(batches)))

    def again(batches):
        yield from row(chosen(rows(batches)))

    def last(batches):
        yield from chosen(rows(batches)).to_batches()

    shape = pa.schema([("word", pa.string()), ("n", pa.int64())])
    packed = "part int, lengths binary, words binary, counts binary"
    d = docs.select(F.make_valid_utf8("text").alias("_text")).mapInArrow(run, packed).repartition("part").sortWithinPartitions("part")
    if not most:
        return d.mapInArrow(every, "word string, n long")
    d, tasks = d.mapInArrow(first, packed), max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while (tasks := -(-tasks // FAN)) > FAN:
        d = d.repartition(tasks, "part").mapInArrow(again, packed)
    return d.repartition(tasks, "part").mapInArrow(last, "word string, n long")


def covering_alphabet(docs: DataFrame, coverage: float = 0.9995) -> DataFrame:
    """ch, n, before: the most frequent characters that together reach ``coverage``. The window sees one row per character."""
    order = W.orderBy(F.desc("n"), "ch")
    f = char_frequency(docs)
    f = f.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0))))
    return f.where(F.col("before") < coverage * F.col("total")).drop("total")


def training_sentences(docs: DataFrame, most_bytes: int = 4192) -> DataFrame:
    """Documents that a vocabulary trainer takes: not empty, and of at most so many bytes."""
    return docs.where(t.nonempty(F.col("text")) & (F.octet_length("text") <= most_bytes))


def vocabulary(docs: DataFrame, size: int = 32_000) -> list[str]:
    """The most frequent words beside the special tokens: at most ``size`` strings reach the driver."""
    rows = word_frequency(docs, size).where(~F.col("word").isin(*SPECIAL)).orderBy(F.desc("n"), "word").limit(size - len(SPECIAL)).collect()
    return [r["word"] for r in rows]


def _token_batches(batches, vocab: list[str]):
    """Each batch of texts (its first column) with the tokens of its rows and all ids end to end. The words never are rows or arrays of the JVM."""
    words = pa.array(vocab, pa.string())
    for batch in batches:
        lists = t.words_of(batch.column(0))
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.index_in(lists.flatten(), words).fill_null(UNKNOWN - len(SPECIAL)).to_numpy(zero_copy_only=False).astype(np.int32) + len(SPECIAL)
        ends = np.cumsum(n + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, EOD, np.int32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = ids
        yield batch, np.concatenate([[0], ends]), out


def tokenised(docs: DataFrame, vocab: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, token_ids (with the end of document). No shuffle; the vocabulary is a broadcast of known size."""
    known = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        for batch, offsets, out in _token_batches(batches, known.value):
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids], names=[*batch.schema.names[1:], "token_ids"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.make_valid_utf8("text").alias("_text"), *keep).mapInArrow(run, f"{kinds}, token_ids array<int>")


def tokenised_by_file(docs: DataFrame, path: str, end: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same with the tokenizer in a file that all executors see: .json (tokenizers) or .model (sentencepiece)."""

    def run(batches):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            encode = lambda x: [e.ids for e in tok.encode_batch_fast(x, add_special_tokens=False)]
        else:
            import sentencepiece

            encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        for batch in batches:
            out = [ids + [end] for ids in encode([x or "" for x in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names[1:], "token_ids"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, f"{kinds}, token_ids array<int>")


#: Tokens of a block of documents laid end to end.
BLOCK = 1 << 18


def as_lists(ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, ids.shape[1], dtype=np.int32)), pa.array(ids.ravel()))


def as_digests(ids: np.ndarray) -> pa.Array:
    """md5 of each row's ids as decimals with blanks between."""
    texts = pc.binary_join(as_lists(ids).cast(pa.list_(pa.string())), " ")
    return pa.array([hashlib.md5(x.as_buffer(), usedforsecurity=False).hexdigest() for x in texts], pa.string())


def packed(tokens: DataFrame, length: int = 2048, key: str = "doc_id", form=as_lists, kind: str = "token_ids array<int>") -> DataFrame:
    """sample_id, token_ids: all documents in the order of ``key``, cut every ``length`` tokens; the rest of the last is left out.

    Rows without a key come last, rows with one key in the order of their tokens' hashes. ``form`` makes the column ``kind`` of samples, given as rows of ids.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = _binary(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), lists.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    ids = tokens.select(key, "token_ids").mapInArrow(run, f"`{key}` {tokens.schema[key].dataType.simpleString()}, ids binary")
    return _packed(ids, "<i4", length, key, form, kind)


def packed_texts(docs: DataFrame, vocab: list[str], length: int = 2048, key: str = "doc_id", form=as_lists, kind: str = "token_ids array<int>") -> DataFrame:
    """``packed`` of the ``tokenised`` texts: their ids are bytes, of two each where that will do, from the words to the samples."""
    known = docs.sparkSession.sparkContext.broadcast(vocab)
    dtype = "<u2" if len(vocab) + len(SPECIAL) <= 1 << 16 else "<i4"

    def run(batches):
        for batch, offsets, out in _token_batches(batches, known.value):
            yield pa.RecordBatch.from_arrays([batch.column(1), _binary(offsets, out.astype(dtype))], names=[key, "ids"])

    ids = docs.select(F.make_valid_utf8("text").alias("_text"), key).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary")
    return _packed(ids, dtype, length, key, form, kind)


def _packed(ids: DataFrame, dtype: str, length: int, key: str, form, kind: str) -> DataFrame:
    """The samples of ``key``, ids.

    Documents are dealt by ranges of ``key`` (the one shuffle of tokens) and laid end to end in blocks; a table of one row per partition tells
    where its first block starts. A block gives the samples that it holds whole; only its two ends, less than a sample each, are grouped with those of others.
    """
    width = np.dtype(dtype).itemsize
    size = BLOCK

    def block(part, place, x):
        ends = [x.tobytes(), x[: length - 1].tobytes(), x[max(0, len(x) - length + 1) :].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place]), pa.array([len(x)]), *(pa.array([e], pa.binary()) for e in ends)], names=["_part", "place", "n", "ids", "head", "tail"])

    def lay(batches):
        part, place, held = TaskContext.get().partitionId(), 0, np.empty(0, dtype)
        for batch in batches:
            held = np.concatenate([held, _elements(batch.column(0), dtype)])
            whole = len(held) // size * size
            for i in range(0, whole, size):
                yield block(part, place + i, held[i : i + size])
            place, held = place + whole, held[whole:]
        if len(held):
            yield block(part, place, held)

    def samples(batches):
        for batch in batches:
            for place, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(value.as_buffer(), dtype)
                skip = -place % length
                n = max(0, len(x) - skip) // length
                if n:
                    first = (place + skip) // length
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), form(x[skip : skip + n * length].reshape(n, length).astype(np.int32))], names=["sample_id", kind.split()[0]])

    d = cut(ids.withColumn("_tie", F.xxhash64("ids")), "tokens")
    order = [F.col(key).asc_nulls_last(), F.col("_tie"), F.col("ids")]
    parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = d.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).select("ids")
    d = carried(cut(d.mapInArrow(lay, "_part int, place long, n long, ids binary, head binary, tail binary"), "blocks"), "n", "place")
    end, skip = F.col("place") + F.col("n"), F.pmod(-F.col("place"), F.lit(length))
    over = end % length
    head = F.when(skip > 0, F.struct(F.col("place").alias("at"), F.substring("head", F.lit(1), (F.least(skip, F.col("n")) * width).cast("int")).alias("ids")))
    tail = F.when((over > 0) & (F.col("n") >= skip), F.struct((end - over).alias("at"), F.substring("tail", (F.octet_length("tail") - over * width + 1).cast("int"), (over * width).cast("int")).alias("ids")))
    s = d.select(F.explode(F.array(head, tail)).alias("s")).where("s is not null")
    s = s.groupBy(F.floor(F.col("s.at") / length).alias("sample_id")).agg(F.array_sort(F.collect_list("s")).alias("s"))  # ``length`` tokens
    s = s.select((F.col("sample_id") * length).alias("place"), F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    return d.select("place", "ids").unionByName(s).mapInArrow(samples, f"sample_id long, {kind}")


def epoch_plan(tokens_per_epoch: Column, samples: int, length: int = 2048, last: float = 0.8) -> list[Column]:
    """epochs that cover the wanted samples, samples of the last one, and whether it is shuffled apart (less than ``last`` full)."""
    per = F.floor((tokens_per_epoch - 1) / length)
    epochs = F.ceil((F.lit(samples) * length + 1) / tokens_per_epoch).cast("long")
    before = F.floor(((epochs - 1) * tokens_per_epoch - 1) / length)
    rest = F.when(epochs == 1, F.lit(samples)).otherwise(F.lit(samples) - before).cast("long")
    return [per.cast("long").alias("samples_per_epoch"), epochs.alias("epochs"), rest.alias("last_epoch_samples"), (rest < last * per).alias("separate_last_epoch")]


def blend_weights(docs: DataFrame, by: str = "source") -> DataFrame:
    """``by``, n_bytes and its share of all. The window sees one row per source."""
    s = docs.groupBy(by).agg(F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))
    return s.withColumn("weight", F.col("n_bytes") / F.sum("n_bytes").over(W.partitionBy(F.lit(0))))


def rendered_chats(turns: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """conv_id, n_turns, text: the turns in order, each after the mark of its role."""
    roles = roles or {"user": "### Human: ", "assistant": "### Assistant: "}
    mark = F.lit("### ")
    mark = F.concat(mark, F.col("role"), F.lit(": "))
    for role, m in roles.items():
        mark = F.when(F.col("role") == role, m).otherwise(mark)
    d = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(mark, F.coalesce("text", F.lit(""))).alias("text")))).alias("t"))  # one conversation
    return d.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def differing_ids(docs: DataFrame, one: str, two: str) -> DataFrame:
    """doc_id, ids_one, ids_two of the texts to which two tokenizer files give different ids; none if they are equivalent on ``docs``."""
    a, b = (tokenised_by_file(docs, path, EOD, ("doc_id", "text")).withColumnRenamed("token_ids", name) for path, name in ((one, "ids_one"), (two, "ids_two")))
    other = b.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), "ids_two")
    return a.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text").eqNullSafe(F.col("_text"))).where("ids_one <> ids_two").select("doc_id", "ids_one", "ids_two").distinct()


def sampled_sentences(docs: DataFrame, n: int = 3_000_000, seed: int = 1234, most_bytes: int = 4192) -> DataFrame:
    """At most ``n`` of the documents that a trainer takes, by the smallest seeded hashes; each task keeps n."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))
    return training_sentences(docs, most_bytes).orderBy(key, "doc_id").limit(n)
