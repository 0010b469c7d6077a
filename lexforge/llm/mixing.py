"""Op 3, mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks of documents.

1. Targets: of all words, each source gets a share by weight, at most ``REPEATS`` times its own words; the excess is
   shared again by weight, round by round, until none is above.
2. A source's documents fall by a hash into blocks of some ``BLOCK_WORDS`` words, whatever its size. Epoch by
   epoch a source's blocks are drawn in a permuted order until they hold its target: whole epochs draw all, the last one
   some. Of its last block, documents in permuted order are taken while they fit, and the one that doesn't is cut after
   the word that fills the target.
3. The tree: the root holds each source's exact number of draws; each node gives half of its shards' draws to the
   left, source after source by a hypergeometric draw, until each leaf is one shard. Numbers come from hashes.
4. A source's draws go in their permuted order to the shards by their quotas, so shards draw disjoint blocks; a shard
   is shuffled by sorting by a hash of draw and document, within itself.

Documents move as (id, source, size). No window or group grows with a source: its blocks are ordered by bins, and only the
documents of one block are ordered. A node of the tree is one row with all sources (some thousands; the tree is no place for millions).
Everything is DataFrame functions.

Defined results: a null text has no words; a null source is one source, the last; sources without words get nothing and
their target is 0. Equal rows are numbered and drawn each for itself; which of them is which does not matter. Rows that share a
doc_id but differ are different documents. Extra columns are carried by ``mixed`` and not read by the query. Ties in an order
go by hash, then doc_id. Very long texts are a block of their own or share one. Without rows there is no mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, small, table

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Words in a block, about.
BLOCK_WORDS = 2_000
#: Equal rows that are made from one at a time.
SALT = 64
#: Least shards, and words in a shard beyond that, about.
SHARDS = 16
SHARD_WORDS = 10_000_000
SEED = 1234


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, copy, copies, source, size (words): a row for each of ``docs``; equal rows differ in ``copy`` (0, 1, ...).

    Written to the shared folder: the texts are read once. Equal rows are counted where they are, and numbered by what is counted.
    """
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = cut(docs.select("doc_id", row_hash(docs).alias("row_hash"), "source", n.alias("size")), "mix-rows")
    d = d.groupBy("doc_id", "row_hash", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    return cut(d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))), "mix-sizes")


def row_hash(docs: DataFrame) -> Column:
    """Of all columns (maps have no hash)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def targets(d: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, sid (its rank by code point, null last), source_size, weight, target. ``d`` has source and size (words).

    Sources are ranked in ranges, with an offset for each range. The level comes from sums: sources that are full at one
    level stay full at higher ones, so that sharing out what the full ones leave ends after a few rounds.
    """
    s = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = max(1, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = cut(s.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-sources")
    first = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    first = first.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    s = s.join(F.broadcast(first), "_part").withColumn("sid", F.col("_first") + F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int")))
    s = cut(s.select("source", "sid", "source_size", "weight", (repeats * F.col("source_size").cast("double")).alias("cap")), "mix-caps")
    total, level, full = s.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("cap") <= level * F.col("weight")
        n, capped, open_ = s.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not open_:
            break
        full, level = n, (total - capped) / open_
    return s.select("source", "sid", "source_size", "weight", F.least("cap", level * F.col("weight")).alias("target"))


def blocked(d: DataFrame, goal: DataFrame) -> DataFrame:
    """``sizes`` with sid and the block of each document."""
    g = goal.select(F.col("source").alias("_source"), "sid", _blocks().alias("_blocks"))
    block = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "row_hash", "copy"), F.col("_blocks"))
    return d.join(small(g), d.source.eqNullSafe(g._source)).select(*d.columns, "sid", block.alias("block"))


def _blocks() -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("long")


def draws(blocks: DataFrame, goal: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sid, block, epoch, place (of the source's draws, from 0), need: the words it may take, null for all.

    ``blocks``: sid, block, size. ``goal``: sid, source_size, target. The permuted order of n blocks goes by bins, some sqrt(n) of
    sqrt(n) blocks each: sums over bins say what comes before a bin, and a window sees one bin.
    """
    g = goal.select("sid", "source_size", F.round("target").cast("long").alias("goal"), F.ceil(F.sqrt(_blocks())).cast("long").alias("bins"))
    b = blocks.where("size > 0")
    g = g.join(b.groupBy("sid").agg(F.count(F.lit(1)).alias("filled")), "sid")
    d = b.join(small(cut(g, "mix-goals")), "sid").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("need", F.least(F.col("goal") - F.col("epoch") * F.col("source_size"), "source_size")).where("need > 0")
    d = d.withColumn("o", F.xxhash64(F.lit(SEED + 1), "sid", "epoch", "block")).withColumn("bin", F.pmod("o", F.col("bins")))
    d = cut(d, "mix-order")
    past = W.partitionBy("sid", "epoch").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    sums = d.groupBy("sid", "epoch", "bin", "need").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("sid", "epoch", "bin", "need", F.coalesce(F.sum("words").over(past), F.lit(0)).alias("words"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n")).where("words < need").drop("need")
    order = W.partitionBy("sid", "epoch", "bin").orderBy("o", "block")
    d = d.join(sums, ["sid", "epoch", "bin"])
    d = d.withColumn("before", F.col("words") + F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("place", F.col("epoch") * F.col("filled") + F.col("n") + F.row_number().over(order) - 1).where("before < need")
    return d.select("sid", "block", "epoch", F.when(F.col("before") + F.col("size") > F.col("need"), F.col("need") - F.col("before")).alias("need"), "place")


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``total`` are ``marked``, by inversion of the uniform ``u``.

    Probabilities go up and down from the mode; what lies beyond 40 and 12 standard deviations is below what a double holds.
    """
    f = lambda c: c.cast("double")
    low, high = F.greatest(F.lit(0).cast("long"), drawn + marked - total), F.least(drawn, marked)
    mode = F.least(high, F.greatest(low, F.floor((f(drawn) + 1) * (f(marked) + 1) / (f(total) + 2))))
    sd = F.sqrt(f(drawn) * f(marked) / F.greatest(f(total), F.lit(1.0)) * (1 - f(marked) / F.greatest(f(total), F.lit(1.0))))
    # what is used often is bound to a name, so that it is computed once
    known = F.struct(mode.alias("mode"), F.least(high - mode, (40 + 12 * sd).cast("long")).alias("up"), F.least(mode - low, (40 + 12 * sd).cast("long")).alias("down"), f(marked).alias("marked"), f(drawn).alias("drawn"), (f(total) - f(marked) - f(drawn)).alias("rest"))
    return _bound(known, lambda x: F.coalesce(_bound(u * _walk(x, None)["sum"], lambda goal: _walk(x, goal)["k"]), x["mode"]))


def _walk(x: Column, goal: Column | None) -> Column:
    """The sum of all weights, or the first k at which their running sum reaches ``goal``: from the mode up, then down."""
    ratio = lambda k: (x["marked"] - k) * (x["drawn"] - k) / ((k + 1) * (x["rest"] + k + 1))  # noqa: E731  p(k + 1) / p(k)
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), (none if goal is None else F.when(F.lit(1.0) >= goal, x["mode"])).alias("k"))

    def step(a, i, sign):
        p = a["p"] * (ratio((x["mode"] + i - 1).cast("double")) if sign > 0 else 1 / ratio((x["mode"] - i).cast("double")))
        k = none if goal is None else F.coalesce(a["k"], F.when(a["sum"] + p >= goal, x["mode"] + sign * i))
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), k.alias("k"))

    steps = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))
    one = F.aggregate(steps(x["up"]), start, lambda a, i: step(a, i, 1))
    again = F.struct(F.lit(1.0).alias("p"), one["sum"].alias("sum"), one["k"].alias("k"))
    return F.aggregate(steps(x["down"]), again, lambda a, i: step(a, i, -1))


def tree(quotas: DataFrame, shards: int) -> DataFrame:
    """shard, source, n, start: how many draws of a source a shard gets, and the place of the first. ``quotas``: source, n.

    A level of the tree has a row for each node, with the sources that it still has draws of.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("source", F.col("n").cast("long").alias("n")))).alias("q"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))
    node = node.select(F.lit(0).alias("first"), F.lit(shards).alias("shards"), "q", "total")
    for depth in range((shards - 1).bit_length()):
        # a node's number of draws goes to its two halves as their shards do; the rest of a division to the left
        half = F.ceil(F.col("shards") / 2).cast("int")
        take = F.when(F.col("shards") > 1, F.ceil(F.col("total") * half / F.col("shards"))).otherwise(F.col("total")).cast("long")
        node = node.withColumn("half", half).withColumn("take", take)
        start = F.struct(F.col("total").alias("rest"), F.col("take").alias("want"), F.array().cast("array<long>").alias("out"))
        uniform = lambda s: (F.pmod(F.xxhash64(F.lit(SEED + 2 + depth), "first", s), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))  # noqa: E731, B023

        def step(a, x):
            n = hypergeometric(a["rest"], x["n"], a["want"], uniform(x["source"]))  # noqa: B023
            return _bound(n, lambda n: F.struct((a["rest"] - x["n"]).alias("rest"), (a["want"] - n).alias("want"), F.array_append(a["out"], n).alias("out")))

        node = node.withColumn("left", F.aggregate("q", start, step, lambda a: a["out"]))
        left = F.zip_with("q", "left", lambda x, n: F.struct(x["source"].alias("source"), n.alias("n")))
        right = F.zip_with("q", "left", lambda x, n: F.struct(x["source"].alias("source"), (x["n"] - n).alias("n")))
        some = lambda q: F.filter(q, lambda x: x["n"] > 0)
        kids = F.array(F.struct(F.col("first"), F.col("half").alias("shards"), some(left).alias("q"), F.col("take").alias("total")), F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("shards") - F.col("half")).alias("shards"), some(right).alias("q"), (F.col("total") - F.col("take")).alias("total")))
        node = cut(node.select(F.explode(kids).alias("k")).select("k.*").where("shards > 0"), "mix-tree")
    leaf = node.select(F.col("first").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source", "x.n")
    before = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return leaf.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plan(d: DataFrame, shards: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, documents with their block, draws with their shard) of ``sizes``."""
    goal = cut(targets(d), "mix-targets")
    d = blocked(d, goal)
    drawn = cut(draws(d.groupBy("sid", "block").agg(F.sum("size").alias("size")), goal), "mix-draws")
    if shards is None:
        words = goal.agg(F.sum("source_size")).first()[0] or 0
        shards = max(SHARDS, -(-words // SHARD_WORDS))
    parts = tree(drawn.groupBy(F.col("sid").alias("source")).agg(F.count(F.lit(1)).alias("n")), shards)
    place = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))
    parts = parts.select(F.col("source").alias("sid"), "shard", place.alias("place"))
    return goal, d, cut(drawn.join(parts, ["sid", "place"]), "mix-placed")


def takes(d: DataFrame, drawn: DataFrame) -> DataFrame:
    """doc_id, row_hash, copy, copies, epoch, shard, words: one row for each time that a row is taken; words: how many of its first."""
    got = d.where("size > 0").join(drawn.select("sid", "block", "epoch", "shard", "need"), ["sid", "block"])
    whole = got.where("need is null").withColumn("words", F.col("size"))
    # the last block of each source
    order = W.partitionBy("sid", "block", "epoch").orderBy(F.xxhash64(F.lit(SEED + 9), "epoch", "doc_id", "row_hash", "copy"), "doc_id", "row_hash", "copy")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = got.where("need is not null").withColumn("words", F.least("size", F.greatest(F.col("need") - before, F.lit(0)))).where("words > 0")
    return whole.unionByName(part).select("doc_id", "row_hash", "copy", "copies", "epoch", "shard", F.col("words").cast("long").alias("words"))


def mixed(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document is taken, dealt by shard.

    The text of a cut document ends with its last word taken; n_chars follows if it is there. In each shard the order is
    that of a hash of draw and document. Of equal rows one meets what all of them are taken for, SALT of them at a time.
    """
    _, d, drawn = plan(sizes(docs), shards)
    t = takes(d, drawn).groupBy("doc_id", "row_hash", "copy", "copies").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "words"))).alias("_draws"))  # REPEATS entries
    t = cut(t.withColumnsRenamed({"doc_id": "_id", "row_hash": "_hash", "copy": "_copy", "copies": "_copies"}), "mix-takes")
    x = docs.withColumn("_row", row_hash(docs))
    same = lambda t: x.doc_id.eqNullSafe(t._id) & (F.col("_row") == t._hash)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    one = small(t.where("_copies = 1"))
    out = x.join(one, same(one)).select(*keep, "_hash", "_copy", "_draws")
    many = t.where("_copies > 1")
    groups = cut(many.groupBy("_id", "_hash").agg(F.ceil(F.max("_copies") / SALT).cast("long").alias("_salts")), "mix-equal")
    if groups.limit(1).count():
        g = small(groups)
        x = x.join(g, same(g)).dropDuplicates(["_id", "_hash"]).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_id", "_hash")
        many = many.withColumn("_salt_", F.floor(F.col("_copy") / SALT))
        out = out.unionByName(x.join(many, same(many) & (x._salt == many._salt_)).select(*keep, "_hash", "_copy", "_draws"))
    x = out.withColumn("_draw", F.explode("_draws"))
    size = F.regexp_count("text", F.lit(WORD))
    cut_ = F.col("_draw.words") < size
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_draw.words").cast("int")), "")
    x = x.withColumn("_cut", cut_).withColumn("text", F.when(F.col("_cut"), some).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    x = x.repartition("_draw.shard").sortWithinPartitions("_draw.shard", F.xxhash64(F.lit(SEED + 10), "_draw.shard", "_draw.epoch", "_hash", "_copy", "doc_id"))
    return x.select(docs.columns)


def op3_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    goal, d, drawn = plan(sizes(table(spark, sf_dir, "documents")))
    key = ["doc_id", "row_hash", "copy"]
    got = takes(d, drawn).groupBy(*key).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards"))  # REPEATS entries
    got = got.withColumnsRenamed({c: f"_{c}" for c in key})
    out = d.join(small(goal.select("sid", "source_size", "target")), "sid")
    out = out.join(got, out.doc_id.eqNullSafe(F.col("_doc_id")) & (out.row_hash == F.col("_row_hash")) & (out.copy == F.col("_copy")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shards")
