"""Op 8, MinHash near-dedup: bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its word shingles; its sketch is the K smallest.

1. Equal sets form classes; only the smallest doc_id of each, its representative, goes on.
2. Of two sets with a Jaccard similarity of 0.8 or more, the K smallest values of the union lie in both with a
   chance of 0.8 each. At least HALF of K do but for a chance of some 1e-9. So, in any one order of all values,
   the first |sketch| - HALF + 1 values of both sketches have one in common. The order is by rising number of
   representatives that retain a value; values of one representative need no list. This keeps frequent
   shingles, such as those of a passage that many documents share, out of most lists.
3. Inverted lists of those values generate pairs: short lists (at most SHORT) all of their pairs; long ones only
   pairs with a few leaders. The union sketch estimates the similarity and drops pairs far below; the full sets
   confirm links.
4. What long lists connect is a region. Sets with more than a fifth of values that nothing else in the region has are linked with
   nothing and go out; this takes one count of values. What then is not in the largest component of its region is compared by
   its full set, block by block, with all of the region, so that no link between components is lost; a block emits
   at most a pair a row. Links inside a component change nothing. The work here is that of a region's outsiders times the
   region, some nanoseconds a pair and shared value.
5. Components: minimum labels by alternating large and small stars, on tables in the shared folder.

Nothing of the size of the documents reaches the driver; a side is broadcast only after its bytes are counted, or where it holds
the few keys that fill a set share of all rows (``join_heads``).

Defined results: a text without words, or null, has an empty set, is its own component and is kept. A row without
doc_id takes part with its text only if another row has the same set; alone, its component is null and it is kept.
Rows that share one doc_id count as one document for links, and each has its own row in the result. An empty table has an empty
result. A very long text is one set like others. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import join_heads
from .common import buffer, cut, mix, pieces, small, table, tidy, word_hashes

K = 64
HALF = 32
SHORT = 64
LEADERS = 4
#: Bytes of text that a task goes through at a time.
PIECE = 1 << 20
#: Edges that a task joins at a time, 16 bytes each.
EDGES = 1_000_000
#: Values of the sets in a block, 8 bytes each; a set with more is alone.
BLOCK = 1 << 17


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int):
    """For each text of a piece its sorted distinct shingle hashes."""
    h, cuts = word_hashes(raw[at[0] : at[-1]], at - at[0])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        w = h[a:b]
        n = min(width, len(w))
        if not n:
            yield w
            continue
        g = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            g = mix(g * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
        g.sort()
        yield g[np.concatenate([[True], g[1:] != g[:-1]])]


def sketches(docs: DataFrame, width: int, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n, d1 and d2 (a digest of the set), sketch (K smallest values, as bytes)."""

    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))

    def run(batches):
        for batch in batches:
            raw, at = buffer(batch.column(1))
            for i, j in pieces(at, PIECE):
                n, d1, d2, kept = [], [], [], []
                for s in shingle_sets(raw, at[i : j + 1], width):
                    n.append(len(s))
                    d1.append(int((s * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64)) if len(s) else 0)
                    d2.append(int(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)) if len(s) else 0)
                    kept.append(s[:K].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(n, pa.int64()), signed(d1), signed(d2), pa.array(kept, pa.binary())], names=["doc_id", "text_hash", "n", "d1", "d2", "sketch"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_hash")).mapInArrow(tidy(run), "doc_id long, text_hash long, n long, d1 long, d2 long, sketch binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, at = buffer(batch.column(1))
            for i, j in pieces(at, PIECE):
                kept = [s.tobytes() for s in shingle_sets(raw, at[i : j + 1], width)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(kept, pa.binary())], names=["id", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(tidy(run), "id long, set binary")


# ---- lists -------------------------------------------------------------------------------------------


def _values(reps: DataFrame) -> DataFrame:
    """(id, n, value) of all retained values."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                v = [np.frombuffer(x.as_py(), np.int64) for x in part.column(2)]
                at = pa.array(np.repeat(np.arange(len(v)), [len(x) for x in v]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(v))], names=["id", "n", "value"])

    return reps.select("id", "n", "sketch").mapInArrow(tidy(run), "id long, n long, value long")


def lists(reps: DataFrame) -> DataFrame:
    """(value, id, n): the inverted lists of the values that a pair must share one of; see 2. above."""
    every = _values(reps)
    counted = every.groupBy("value").agg(F.count(F.lit(1)).alias("df"))
    shared = cut(counted.where("df > 1"), "near-values")
    have = join_heads(every, shared, ["value"], "df", K * reps.count()).groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))  # K entries at most
    kept = F.least("n", F.lit(K))
    need = F.when(F.col("n") <= K * 4 // 5, F.ceil(F.col("n") * 4 / 5)).otherwise(F.lit(HALF))
    room = (kept - need + 1 - (kept - F.size("v"))).cast("int")  # values that no other has come first and have no list
    return have.where(room > 0).select("id", "n", F.explode(F.slice("v", F.lit(1), room)).alias("v")).select(F.col("v.value").alias("value"), "id", "n")


# ---- pairs -------------------------------------------------------------------------------------------


def _union_estimate(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sketches allow a similarity of 0.8: HALF of the K smallest of the union in both, or 0.8 of all."""
    u = np.concatenate([a, b])
    u.sort()
    same = u[1:] == u[:-1]
    # the K-th smallest distinct value bounds what counts
    distinct = np.flatnonzero(np.concatenate([[True], ~same]))
    whole = len(a) < K and len(b) < K
    if whole:
        return 5 * int(same.sum()) >= 4 * len(distinct)
    stop = distinct[K] if len(distinct) > K else len(u)
    return int(same[: stop - 1].sum()) >= HALF


def _both(pairs: DataFrame, held: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) whose two values of ``column`` in ``held`` pass ``test``."""
    one = held.select(F.col("id").alias("a"), F.col(column).alias("x"))
    two = held.select(F.col("id").alias("b"), F.col(column).alias("y"))

    def run(batches):
        for batch in batches:
            ok = pa.array([test(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long").distinct()


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sorted sets have a Jaccard similarity of at least 0.8."""
    if len(a) > len(b):
        a, b = b, a
    if 5 * len(a) < 4 * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 5 * common >= 4 * (len(a) + len(b) - common)


def _close(n, m):
    return (n * 5 >= m * 4) & (m * 5 >= n * 4)


class Links:
    """Confirms pairs and keeps the components that they make."""

    def __init__(self, docs: DataFrame, reps: DataFrame, listed: DataFrame, width: int):
        self.reps = reps
        ids = cut(listed.select("id").distinct(), "near-ids")
        self.held = cut(reps.select("id", "n", "sketch").join(small(ids), "id", "left_semi"), "near-held")
        chosen = docs.select("doc_id", "text").join(small(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
        self.sets = cut(_sets(chosen, width), "near-sets")
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def crossing(self, pairs: DataFrame) -> DataFrame:
        if self.labels is None:
            return pairs
        a, b = (self.labels.select(F.col("id").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
        root = lambda k: F.coalesce(f"root_{k}", k)
        return pairs.join(a, "a", "left").join(b, "b", "left").where(root("a") != root("b")).select("a", "b")

    def confirm(self, pairs: DataFrame) -> None:
        """Adds the links among ``pairs``."""
        likely = cut(_both(self.crossing(pairs), self.held, "sketch", _union_estimate), "near-likely")
        found = cut(_both(likely, self.sets, "set", _linked), "near-links")
        self.links = found if self.links is None else self.links.unionByName(found)
        self.add(found)

    def add(self, found: DataFrame) -> None:
        """Joins the components that the links ``found`` connect."""
        star = found if self.labels is None else self.labels.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found)
        self.labels = components(star)


def stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges (x, y): each id that isn't the smallest of its component, and that one."""
    if not len(x):
        return x, y
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    p, q = at[: len(x)], at[len(x) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(ids)))
    return ids[far], ids[root[far]]


def _local_stars(edges: DataFrame) -> DataFrame:
    """Edges of the same components, fewer of them: each task joins what it has of them, EDGES at a time."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            n += batch.num_rows
            if n > EDGES:
                held = [stars(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                n = len(held[0][0])
                if 2 * n > EDGES:  # these no longer become fewer
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held.pop()], names=["a", "b"])
                    n = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in stars(*(np.concatenate(c) for c in zip(*held, strict=True)))], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all ids that are not the smallest of their component, from edges (a, b)."""
    now = cut(_local_stars(edges), "near-stars")
    if now.limit(EDGES + 1).count() <= EDGES:  # one task holds them all
        done = cut(_local_stars(now.repartition(1)), "near-stars")
        return done.select(F.col("a").alias("id"), F.col("b").alias("root"))
    now = now.where("a <> b").distinct()
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # large star: each larger neighbour to the smallest of the neighbourhood
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = _local_stars(large.distinct()).where("a <> b").distinct()
        # small star: the smaller neighbours, and the node itself, to the smallest one
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small_ = large.join(down, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(down.select("a", F.col("low").alias("b")))
        new = cut(small_.where("a <> b").distinct(), "near-stars")
        # done when every id has one root, and no root is itself under another
        many = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        deep = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if not many.limit(1).count() and not deep.limit(1).count():
            return new.select(F.col("a").alias("id"), F.col("b").alias("root"))
        now = new


def _short_pairs(rows: DataFrame) -> DataFrame:
    one = rows.select("value", F.col("id").alias("a"), F.col("n").alias("n_a"))
    two = rows.select("value", F.col("id").alias("b"), F.col("n").alias("n_b"))
    return one.join(two, "value").where((F.col("a") < F.col("b")) & _close(F.col("n_a"), F.col("n_b"))).select("a", "b").distinct()


def _star_pairs(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs of each row with the leaders of its lists. A row's lists mostly have the same leaders, so they are united first."""
    x = rows.join(small(cut(leaders, "near-leaders")), "value").groupBy("id", "n").agg(F.array_distinct(F.flatten(F.collect_set("leaders"))).alias("leaders"))  # K lists at most
    x = x.select("id", "n", F.explode("leaders").alias("l")).where((F.col("id") != F.col("l.leader")) & _close(F.col("n"), F.col("l.n_leader")))
    return x.select(F.least("id", "l.leader").alias("a"), F.greatest("id", "l.leader").alias("b")).distinct()


def _leaders(rows: DataFrame, order: list) -> DataFrame:
    """(value, leaders): of each list the rows that come first in each order, as an array of (leader, n_leader)."""
    first = rows.groupBy("value").agg(*[F.min(F.struct(o, "id", "n")).alias(f"l{i}") for i, o in enumerate(order)])
    many = F.array(*[F.struct(F.col(f"l{i}.id").alias("leader"), F.col(f"l{i}.n").alias("n_leader")) for i in range(len(order))])
    return first.select("value", F.array_sort(F.array_distinct(many)).alias("leaders"))


def _common(one: list[np.ndarray], two: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``one`` with all of ``two``, by products of bit matrices, some columns at a time."""
    n = [len(x) for x in one + two]
    owner = np.repeat(np.arange(len(n)), n)
    _, column, times = np.unique(np.concatenate(one + two), return_inverse=True, return_counts=True)
    some = times > 1
    column, owner = (np.cumsum(some) - 1)[column[some[column]]], owner[some[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(one), len(two)), np.float32)
    total = int(some.sum())
    for k in range(0, total, width):
        i, j = np.searchsorted(column, (k, k + width))
        bits = np.zeros((len(n), min(width, total - k)), np.float32)
        bits[owner[i:j], column[i:j] - k] = 1
        out += bits[: len(one)] @ bits[len(one) :].T
    return out


def _linkable(d: DataFrame) -> DataFrame:
    """Those of ``d`` (id, n, set) that can have a link in it: at least 0.8 of a linked set's values are in another set, too.

    So texts that share a passage, and are else their own, go out before anything is compared. Values that one id has are counted
    by value and then by id; nothing is joined by value.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                v = [np.frombuffer(x.as_py(), np.int64) for x in part.column(1)]
                at = pa.array(np.repeat(np.arange(len(v)), [len(x) for x in v]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.concatenate(v))], names=["id", "value"])

    own = d.select("id", "set").mapInArrow(tidy(run), "id long, value long").groupBy("value").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("df")).where("df = 1")
    own = own.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    return d.join(cut(own, "near-own"), "id", "left").where(5 * F.coalesce("own", F.lit(0)) <= F.col("n")).drop("own")


def _rest_links(rows: DataFrame, links: Links) -> DataFrame:
    """What long lists still link between components: pairs (a, b) that are connected by links between exact sets.

    Regions are the ids that long lists connect. What lies outside of the largest component of its region, in parts, is
    compared with all of the region, in blocks; parts and blocks hold some BLOCK values each.
    """
    first = cut(rows.groupBy("value").agg(F.min("id").alias("b")), "near-first")
    regions = components(rows.join(small(first), "value").where("id <> b").select(F.col("id").alias("a"), "b").distinct())
    d = rows.select("id", "n").distinct().join(regions.withColumnRenamed("root", "region"), "id", "left").withColumn("region", F.coalesce("region", "id"))
    d = d.join(links.labels, "id", "left").withColumn("root", F.coalesce("root", "id")) if links.labels is not None else d.withColumn("root", F.col("id"))
    d = cut(d, "near-regions")
    sizes = d.groupBy("region", "root").agg(F.sum("n").alias("size"))
    top = sizes.groupBy("region").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("all")).where(F.col("all") > F.col("top.size"))
    up = lambda c: F.ceil(c / BLOCK).cast("int")
    top = top.select("region", F.col("top.root").alias("main"), up(F.col("all") - F.col("top.size")).alias("parts"), up(F.col("all")).alias("blocks"))
    top = cut(top, "near-tops")
    d = cut(d.join(small(top), "region").join(links.sets, "id"), "near-rest")
    d = _linkable(d)
    h = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    few = d.where("root <> main").withColumn("i", h("parts")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("few", F.lit(True))
    every = d.withColumn("j", h("blocks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("few", F.lit(False))
    columns = ["region", "i", "j", "few", "id", "root", "set"]

    def run(t: pa.Table) -> pa.Table:
        few = t["few"].to_numpy()
        ids, root = t["id"].to_numpy(), t["root"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t["set"]]
        one, two = np.flatnonzero(few), np.flatnonzero(~few)
        x = y = np.zeros(0, np.int64)
        if len(one) and len(two):
            n = np.array([len(s) for s in sets])
            common = _common([sets[k] for k in one], [sets[k] for k in two])
            ok = 5 * common >= 4 * (n[one][:, None] + n[two] - common)
            p, q = np.nonzero(ok & (root[one][:, None] != root[two]))
            x, y = stars(ids[one[p]], ids[two[q]])
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return few.select(columns).unionByName(every.select(columns)).groupBy("region", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, text_hash, kept."""
    mine = cut(sketches(docs, width), "near-sketches")
    classes = mine.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    reps = cut(classes, "near-classes")
    listed = cut(lists(reps.where("id is not null")), "near-lists")
    sizes = cut(listed.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-sizes")
    listed = cut(listed.join(small(sizes), "value"), "near-lists")
    links = Links(docs, reps, listed, width)
    long_ = listed.where(F.col("size") > SHORT).select("value", "id", "n")
    first = _short_pairs(listed.where(F.col("size") <= SHORT))
    if long_.limit(1).count():
        first = first.unionByName(_star_pairs(long_, _leaders(long_, [F.xxhash64("id", F.lit(i)) for i in range(LEADERS)])))
        links.confirm(first)
        if links.links is not None:
            # those with the most links so far lead next
            degree = links.links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
            ranked = long_.join(degree, "id", "left")
            links.confirm(_star_pairs(long_, _leaders(ranked, [-F.coalesce("degree", F.lit(0))])))
        links.add(_rest_links(long_, links))
    else:
        links.confirm(first)
    rep = reps.select("d1", "d2", "n", "id", "copies")
    rep = rep.withColumn("root", F.col("id")) if links.labels is None else rep.join(links.labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    out = join_heads(mine.drop("sketch"), cut(rep.drop("id"), "near-roots"), ["d1", "d2", "n"], "copies", mine.count(), "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4).select("doc_id", "n_shingles", "component_id", "kept")
