"""Op 5, secret scans: candidates told apart by how many owners hold them.

Candidates come from the three base patterns and from further ones (``EXTRA``). The digest of a candidate's value is counted
over the whole corpus by distinct owners and repositories: first distinct (digest, owner, repository), so that a value
which a third of all rows hold is aggregated before it moves, then sums. A value of more than ``MAX_OWNERS`` owners or
``MAX_REPOSITORIES`` repositories is an example that is widely copied; others look live. Base spans are always reported; further ones
if live. A private key is matched with its body (``KEY``) and counted by it: the header, which all keys share, says nothing of the
owner. In ``documents`` the column source stands for the owner, and source and lang for the repository.

Everything is DataFrame functions. A text's matches and what stands between them, both by one pattern, give the positions.

Defined results: a null text is empty; a null owner or repository counts as one of its own. Rows with one doc_id and
text have the same result each. Matches that start at one place are ordered by kind. A text of any length is one value. An empty
table has an empty result; other columns are not read (``redacted`` carries them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, table

MAX_OWNERS = 2
MAX_REPOSITORIES = 4
#: Base kinds in their order: pattern, group of the value, least length of the value.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # the same runs as [0-9a-f]+ of 16 and more
)
EXTRA = (
    ("git", r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 30),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 14),
    ("cloud", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    ("pay", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 27),
    ("mixed", r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[A-Z0-9]*[a-z])(?=[a-z0-9]*[A-Z])[A-Za-z0-9]{24,}", 0, 24),
)
#: Where a private key has a body, it is the candidate: from BEGIN through END or, without an END before the next BEGIN, to the end of
#: the base64 lines. Loops over groups are possessive: Java runs those without recursion.
_BEGIN, _END = (f"-----{x} [A-Z ]{{0,30}}PRIVATE KEY-----" for x in ("BEGIN", "END"))
_SEPARATORS = r"""[\s\\"'+,;>#|*-]*+"""
_LINES = rf"""(?:{_SEPARATORS}(?:Proc-Type|DEK-Info|Comment|Version):[^\n\\"]*+(?:\\[nr])*+)*+(?:{_SEPARATORS}[A-Za-z0-9+/]{{24,}}+={{0,2}})*+(?:{_SEPARATORS}[A-Za-z0-9+/]++={{1,2}})?+"""
KEY = rf"{_BEGIN}(?:(?>(?s:.*?)(?=-----(?:END|BEGIN) )){_END}|{_LINES})"
#: Cheap patterns that every match of a further one contains.
HINT = r"gh[pousr]_|xox[abprs]-|AIza|[sr]k_(?:live|test)_|eyJ|-----BEGIN |[A-Za-z0-9]{24}"


def key_body(match: Column) -> Column:
    """The base64 characters of a private key without its BEGIN and END, however its lines are broken; a bare header is itself."""
    body = F.regexp_replace(match, rf"""{_BEGIN}|{_END}|\\[nrt]|["']\s*\+|[^A-Za-z0-9+/=]""", "")
    return F.when(body == "", match).otherwise(body)


def matches(text: Column, pattern: str, group: int, least: int, value: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, end, value), code points, of the matches whose value (of the group, or made by ``value``) has at least ``least`` characters."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    values = F.transform(values, value) if value else values
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.transform(found, lambda m: F.length(m)).alias("n"), F.transform(gaps, lambda g: F.length(g)).alias("gap"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    step = lambda a, r: F.struct((a["at"] + r["gap"] + F.coalesce(r["n"], F.lit(0))).alias("at"), F.when(r["n"].isNull() | (F.length(r["value"]) < least), a["out"]).otherwise(F.array_append(a["out"], F.struct((a["at"] + r["gap"]).alias("start"), (a["at"] + r["gap"] + r["n"]).alias("end"), r["value"].alias("value")))).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(rows, start, step, lambda a: a["out"]))


def candidates(docs: DataFrame, owner: str, repository: list[str]) -> DataFrame:
    """doc_id, text_hash, owner, repository and, by kind, the array of its matches (null: none). Written to the shared folder."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"), F.col(owner).alias("owner"), F.to_json(F.struct(*repository)).alias("repository"))
    d = d.select("*", F.col("text").rlike(HINT).alias("hint"))
    keep = ["doc_id", "text_hash", "owner", "repository"]
    base = [matches(F.col("text"), p, g, n).alias(k) for k, p, g, n in BASE]
    further = {k: matches(F.col("text"), p, g, n) for k, p, g, n in EXTRA} | {"key": matches(F.col("text"), KEY, 0, 1, key_body)}
    more = [F.when(F.col("hint"), further[k]).alias(k) for k, *_ in EXTRA]
    return cut(d.select(*keep, *base, *more), "secrets")


def _all(names: list[str]) -> Column:
    """Array of (start, rank, end, kind, digest) of the matches of all these kinds."""
    ranks = {k: i for i, (k, *_) in enumerate(BASE + EXTRA)}
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,digest:string>>")
    one = lambda k: F.coalesce(F.transform(k, lambda x: F.struct(x["start"].alias("start"), F.lit(ranks[k]).alias("rank"), x["end"].alias("end"), F.lit(k).alias("kind"), F.sha2(x["value"], 256).alias("digest"))), empty)
    return F.concat(*[one(k) for k in names])


def ownership(found: DataFrame) -> DataFrame:
    """digest, n_owners, n_repositories, n_places and whether it looks live. ``found``: digest, owner, repository."""
    d = found.groupBy("digest", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    d = d.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    d = d.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_places"))
    return d.withColumn("live", (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repositories") <= MAX_REPOSITORIES))


def secret_spans(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_<base kind>, base and spans (arrays of start, rank, end, kind), n_live, n_example,
    and the most owners and repositories that one of its values has."""
    kinds = [k for k, *_ in BASE], [k for k, *_ in EXTRA]
    c = candidates(docs, owner, list(repository))
    places = c.select("doc_id", "text_hash", "owner", "repository", F.explode(_all(kinds[0] + kinds[1])).alias("s"))
    held = cut(ownership(places.select("s.digest", "owner", "repository")), "secret-owners")
    judged = places.select("doc_id", "text_hash", "s").withColumn("digest", F.col("s.digest")).join(small(held.select("digest", "live", "n_owners", "n_repositories")), "digest")
    span = F.struct("s.start", "s.rank", "s.end", "s.kind")
    mine = judged.groupBy("doc_id", "text_hash").agg(F.collect_set(F.when((F.col("s.rank") < len(BASE)) | F.col("live"), span)).alias("spans"), F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("example"), F.max("n_owners").alias("owners"), F.max("n_repositories").alias("repositories"))
    mine = mine.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    out = c.join(mine, c.doc_id.eqNullSafe(mine._id) & (c.text_hash == mine._hash), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    spans = F.sort_array(F.coalesce("spans", none))
    return out.select("doc_id", "text_hash", *[F.coalesce(F.size(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds[0]], F.filter(spans, lambda s: s["rank"] < len(BASE)).alias("base"), spans.alias("spans"), F.coalesce("live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("example", F.lit(0)).cast("long").alias("n_example"), F.coalesce("owners", F.lit(0)).alias("most_owners"), F.coalesce("repositories", F.lit(0)).alias("most_repositories"))


def redacted(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with the columns they have; each run of overlapping spans is replaced by ``mark``, and n_chars follows if it is there."""
    s = secret_spans(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans").dropDuplicates(["_id", "_hash"])
    d = docs.withColumn("_text_hash", F.xxhash64("text"))
    s = small(cut(s, "secret-spans"))
    d = d.join(s, d.doc_id.eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, s):
        inside = s["start"] < a["at"]
        before = F.substring("text", a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.when(inside, a["out"]).otherwise(F.concat(a["out"], before, F.lit(mark))).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    text = F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("text"))
    d = d.withColumn("text", text)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(docs.columns)


def op5_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_spans(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return s.select("doc_id", *[f"n_{k}" for k, *_ in BASE], F.sha2(join("base"), 256).alias("base_sha256"), join("spans").alias("spans"), "n_live", "n_example", "most_owners", "most_repositories")
