"""The registered queries: each with its plan and, where SQL can say the same, DuckDB's SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cipher
from ..functions import text as t
from ..operators import corpus, dedup, filters, privacy, scoring, split
from ..shared import cut, table
from ..sources import manifests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEED = 1234
#: Patterns and words of the query chains; users bring their own.
JUNK, ADVERT, SLUR, KEYWORDS = r"[#*$%&]{3}", r"https?://", "thooth", " (?:that|dans|nicht|para) "


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _md5(c) -> F.Column:
    return F.md5(c.cast("binary"))


# ---- SQL that many oracles use -----------------------------------------------------------------------

W = f"'{t.WORD}'"
WORDS = f"regexp_extract_all(coalesce(text, ''), {W})"
NWORDS = f"len({WORDS})"
HASH32 = "('0x' || substr(md5({}), 1, 8))::BIGINT"
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{t.WHITE}]+|[{t.WHITE}]+$', '', 'g')"


def _mask(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{t.EMAIL}', '<EMAIL>', 'g'), '{t.PHONE}', '<PHONE>', 'g')"


SENTENCES = f"""(select doc_id, pos - 1 as pos, s as text from (select doc_id, unnest(s) as s, generate_subscripts(s, 1) as pos from (
  select doc_id, list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda p: regexp_extract_all(p, '{t.SENTENCE}'))), lambda x: {_strip("x")}), lambda x: suffix(x, '.')) as s from documents)))"""
PRIVACY = f"(select doc_id, pos, text, regexp_extract_all(text, '{t.ENTITY}') as persons from {SENTENCES} where len(regexp_extract_all(text, '{t.ENTITY}')) > 0)"


def poly_sql(text: str, key_length: int, seed: int = SEED, longest: int = 150_000) -> str:
    order = cipher.symbols(seed)
    pos = [-1] * (cipher.LAST + 1)
    for i, c in enumerate(order):
        pos[ord(c)] = i
    key = cipher.key_at(seed, key_length, key_length or longest).tolist()
    sym = ",".join(str(ord(c)) for c in order)
    return f"""(select array_to_string(list_transform(string_split({text}, ''), lambda c, i: case when c <> '' and unicode(c) <= {cipher.LAST} and _p[unicode(c) + 1] >= 0
      then chr(_s[(_p[unicode(c) + 1] + _k[(i - 1) % {len(key)} + 1]) % {len(order)} + 1]) else c end), '') from (select {pos}::INT[] as _p, [{sym}]::INT[] as _s, {key}::INT[] as _k) as _c)"""


# ---- sources and sinks -------------------------------------------------------------------------------


@query("scan_documents", "select doc_id, text, lang, source, n_chars from documents")
def scan_documents(spark, sf):
    return docs(spark, sf).select("doc_id", "text", "lang", "source", "n_chars")


@query("scan_by_source", "select source, count(*) as n_docs, sum(n_chars)::BIGINT as n_chars from documents group by source")
def scan_by_source(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("pages_article_filter", "select page_id, url, length(html)::BIGINT as n_chars from pages where url like 'https://%' and not contains(url, '?') and html is not null")
def pages_article_filter(spark, sf):
    p = table(spark, sf, "pages")
    return p.where(F.col("url").startswith("https://") & ~F.col("url").contains("?") & F.col("html").isNotNull()).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("json_valid_rows", "select event_id, json_extract_string(props, '$.k')::BIGINT as k from events where json_valid(props) and json_extract_string(props, '$.k') is not null")
def json_valid_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT", {"mode": "PERMISSIVE"}).alias("p"))
    return e.where("p.k is not null").select("event_id", "p.k")


@query("shard_manifest", "select range as shard, 'train/part.' || lpad(range::VARCHAR, 5, '0') || '-of-01024.json.gz' as name from range(0, 1024) union all select range, 'validation/part.' || lpad(range::VARCHAR, 5, '0') || '-of-00008.json.gz' from range(0, 8)")
def shard_manifest(spark, sf):
    return manifests.shards(spark, "train", 0, 1024).unionByName(manifests.shards(spark, "validation", 0, 8))


_KEY = "regexp_replace(url, '^https?://[^/]+/', '')"


@query("manifest_split_filter", f"select page_id, {_KEY} as key from pages where regexp_matches({_KEY}, '^en/') and {_KEY} not in (select {_KEY} from pages where url like 'http://%')")
def manifest_split_filter(spark, sf):
    p = table(spark, sf, "pages")
    have = p.where(F.col("url").startswith("http://")).select(manifests.key(F.col("url")).alias("key"))
    return manifests.wanted(p.select("page_id", "url"), "url", "en", have).select("page_id", "key")


@query("manifest_expand", "select lang, snapshot, part, 'documents/' || snapshot || '/' || lpad(shard::VARCHAR, 4, '0') || '/' || lang || '_' || part || '.json.gz' as name from (select unnest(['en', 'de', 'fr', 'es', 'it']) as lang), (select unnest(['2022-49', '2023-06']) as snapshot), (select unnest(['head', 'middle']) as part), (select range as shard from range(0, 50))")
def manifest_expand(spark, sf):
    return manifests.expanded(spark, ["en", "de", "fr", "es", "it"], ["2022-49", "2023-06"], ["head", "middle"], 50)


@query("corpus_concat", "select length(t)::BIGINT as n_chars, md5(t) as digest from (select string_agg(text, chr(10) || chr(10) order by item_id) as t from benchmark)")
def corpus_concat(spark, sf):
    # one value by its nature: for test sets, not corpora
    b = table(spark, sf, "benchmark").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("t"))
    b = b.select(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("t"))
    return b.select(F.length("t").cast("long").alias("n_chars"), _md5(F.col("t")).alias("digest"))


@query("merge_shards", "select doc_id, source, n_chars, 'a' as shard from documents where lang = 'en' union all select doc_id, source, n_chars, 'b' from documents where lang <> 'en'")
def merge_shards(spark, sf):
    d = docs(spark, sf)
    return split.merged([d.where("lang = 'en'").select("doc_id", "source", "n_chars", F.lit("a").alias("shard")), d.where("lang <> 'en'").select(F.lit("b").alias("shard"), "doc_id", "source", "n_chars")])


@query("hash_shard", "select doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(text), (8 * i + 1)::BIGINT, 8))::BIGINT)), lambda a, x: (a * 96 + x % 100) % 100) as shard from documents")
def hash_shard(spark, sf):
    return docs(spark, sf).select("doc_id", t.sha256_mod(F.col("text"), 100).alias("shard"))


@query("nonempty_text", "select doc_id, length(text)::BIGINT as n from documents where coalesce(length(text), 0) > 0")
def nonempty_text(spark, sf):
    return docs(spark, sf).where(t.nonempty(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n"))


# ---- words, lines, patterns --------------------------------------------------------------------------


@query("explode_paragraphs", "select doc_id, (generate_subscripts(p, 1) - 1)::INT as pos, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents)")
def explode_paragraphs(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(t.lines(F.col("text"))).alias("pos", "line"))


@query("sentences_with_period", f"select doc_id, pos::INT as pos, text from {SENTENCES}")
def sentences_with_period(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "text"))


@query("word_count", f"select doc_id, {NWORDS}::BIGINT as n_words from documents")
def word_count(spark, sf):
    return docs(spark, sf).select("doc_id", t.word_count(F.coalesce("text", F.lit(""))).alias("n_words"))


@query("word_tokenize", f"select doc_id, len({WORDS})::BIGINT as n, md5(array_to_string({WORDS}, '|')) as digest from documents")
def word_tokenize(spark, sf):
    w = t.words(F.coalesce("text", F.lit("")))
    return docs(spark, sf).select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), _md5(F.array_join("w", "|")).alias("digest"))


@query("drop_date_tokens", f"select doc_id, array_to_string(list_filter({WORDS}, lambda x: not regexp_matches(x, '{t.DATE}')), ' ') as text from documents")
def drop_date_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(t.drop_dates(t.words(F.coalesce("text", F.lit("")))), " ").alias("text"))


@query("drop_oneword_lines", f"select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, {W})) > 1), chr(10)) as text from documents")
def drop_oneword_lines(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(t.drop_oneword(t.lines(F.col("text"))), "\n").alias("text"))


@query("keyword_ratio_reject", f"select doc_id, {NWORDS} > 0 and len(regexp_extract_all(text, '{KEYWORDS}')) / {NWORDS} > 0.01 as is_rejected from documents")
def keyword_ratio_reject(spark, sf):
    return docs(spark, sf).select("doc_id", t.keyword_ratio_exceeds(F.col("text"), KEYWORDS).alias("is_rejected"))


@query("discard_by_pattern_count", f"select doc_id, len(regexp_extract_all(text, '{JUNK}')) > 2 as junk, len(regexp_extract_all(text, '{ADVERT}')) > 2 as advert, len(regexp_extract_all(text, '{SLUR}')) > 0 as slur from documents")
def discard_by_pattern_count(spark, sf):
    c = F.col("text")
    return docs(spark, sf).select("doc_id", t.pattern_exceeds(c, JUNK, 2).alias("junk"), t.pattern_exceeds(c, ADVERT, 2).alias("advert"), t.pattern_exceeds(c, SLUR, 0).alias("slur"))


@query("mask_pii", f"select doc_id, {_mask('text')} as text from documents")
def mask_pii(spark, sf):
    return docs(spark, sf).select("doc_id", t.mask_pii(F.col("text")).alias("text"))


@query("normalize_nfc", "select doc_id, nfc_normalize(text) as text from documents")
def normalize_nfc(spark, sf):
    return docs(spark, sf).select("doc_id", t.normalizer("NFC")(F.col("text")).alias("text"))


@query("normalize_nfkc")
def normalize_nfkc(spark, sf):
    return docs(spark, sf).select("doc_id", t.normalizer("NFKC")(F.col("text")).alias("text"))


# ---- chains ------------------------------------------------------------------------------------------


def _chain() -> filters.Chain:
    return filters.production(JUNK, ADVERT, SLUR, KEYWORDS, "NFC")


_STEPS = ("empty", "boilerplate", "adverts", "slurs", "keywords")
_WT = f"regexp_extract_all(t, {W})"
CHAIN = f"""(with a as (select *, nfc_normalize(text) as t from documents), b as (select *, case when coalesce(length(t), 0) = 0 then 'empty' when len(regexp_extract_all(t, '{JUNK}')) > 2 then 'boilerplate' when len(regexp_extract_all(t, '{ADVERT}')) > 2 then 'adverts'
  when len(regexp_extract_all(t, '{SLUR}')) > 0 then 'slurs' when len({_WT}) > 0 and len(regexp_extract_all(t, '{KEYWORDS}')) / len({_WT}) > 0.01 then 'keywords' end as reject_reason from a),
  c as (select *, array_to_string(list_filter(string_split(t, chr(10)), lambda x: len(regexp_extract_all(x, {W})) > 1), chr(10)) as u from b),
  d as (select *, array_to_string(list_filter(regexp_extract_all(u, {W}), lambda x: not regexp_matches(x, '{t.DATE}')), ' ') as v from c)
  select doc_id, lang, source, reject_reason, reject_reason is not null as is_rejected, case when reject_reason is null then {_mask("v")} else t end as text from d)"""


@query("compose_pipeline", f"select doc_id, is_rejected, reject_reason, text from {CHAIN}")
def compose_pipeline(spark, sf):
    return _chain().apply(docs(spark, sf)).select("doc_id", "is_rejected", "reject_reason", "text")


@query("pipeline_rejects", f"select doc_id, reject_reason, md5(text) as digest from {CHAIN} where is_rejected")
def pipeline_rejects(spark, sf):
    return _chain().apply(docs(spark, sf)).where("is_rejected").select("doc_id", "reject_reason", _md5(F.col("text")).alias("digest"))


@query("pipeline_stats", f"select source, count(*) as n_docs, count_if(is_rejected)::BIGINT as n_rejected, sum(case when is_rejected then 0 else length(text) end)::BIGINT as kept_chars, {', '.join(f'''count_if(coalesce(reject_reason, '') = '{s}')::BIGINT as rejected_{s}''' for s in _STEPS)} from {CHAIN} group by source")
def pipeline_stats(spark, sf):
    c = _chain()
    return c.statistics(c.apply(docs(spark, sf)), "source")


# ---- copies ------------------------------------------------------------------------------------------

_SHINGLES = f"case when len(w) = 0 then []::VARCHAR[] when len(w) < {dedup.SHINGLE} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {dedup.SHINGLE} + 2), lambda i: array_to_string(w[i : i + {dedup.SHINGLE} - 1], ' ')) end"
_SIGS = f"""(select doc_id, source, [{", ".join(f"min((h * {a} + {b}) % {dedup.PRIME})" for a, b in dedup.coefficients())}] as sig from
  (select doc_id, source, {HASH32.format("s")} as h from (select doc_id, source, unnest({_SHINGLES}) as s from (select doc_id, source, {WORDS} as w from documents))) group by doc_id, source)"""
_BANDS = f"""(select doc_id, source, b as band, md5(array_to_string(sig[b * {dedup.ROWS} + 1 : (b + 1) * {dedup.ROWS}], ',')) as key from {_SIGS}, (select range as b from range(0, {dedup.PERMUTATIONS // dedup.ROWS})))"""


@query("minhash_signature", f"select doc_id, md5(array_to_string(sig, ',')) as digest from {_SIGS}")
def minhash_signature(spark, sf):
    return dedup.signatures(docs(spark, sf), ["doc_id"]).select("doc_id", _md5(F.array_join("sig", ",")).alias("digest"))


@query("minhash_dedup", f"select doc_id, doc_id in (select doc_id from (select doc_id, min(doc_id) over (partition by band, key) as first from {_BANDS}) where first < doc_id) as is_rejected from documents")
def minhash_dedup(spark, sf):
    return dedup.near_copies(docs(spark, sf))


@query("minhash_dedup_by_source", f"select doc_id, source, doc_id in (select doc_id from (select doc_id, min(doc_id) over (partition by source, band, key) as first from {_BANDS}) where first < doc_id) as is_rejected from documents")
def minhash_dedup_by_source(spark, sf):
    return dedup.near_copies(docs(spark, sf), ["source"])


@query("exact_dedup", "select doc_id, min(doc_id) over (partition by text) as first_id, min(doc_id) over (partition by text) < doc_id as is_rejected from documents")
def exact_dedup(spark, sf):
    return dedup.exact_copies(docs(spark, sf))


# ---- splits ------------------------------------------------------------------------------------------

_PART = f"case when {HASH32.format(f'''{SEED}::VARCHAR || ':' || doc_id''')} / 4294967296.0 < 0.9 then 'encrypt' else 'plain' end"


@query("split_encrypt_plain", f"select doc_id, {_PART} as part from documents where length(text) > 0")
def split_encrypt_plain(spark, sf):
    return split.bernoulli(docs(spark, sf), 0.9, SEED).select("doc_id", "part")


@query("sample_exact_n", f"select doc_id from documents order by md5('{SEED}:' || doc_id), doc_id limit 100")
def sample_exact_n(spark, sf):
    return split.sample_exact(docs(spark, sf).select("doc_id"), 100, SEED)


@query("seeded_shuffle", f"select doc_id, row_number() over (order by md5('{SEED}:' || doc_id), doc_id) - 1 as position from documents")
def seeded_shuffle(spark, sf):
    return split.shuffled(docs(spark, sf).select("doc_id"), SEED)


@query("split_949_50_1", "select doc_id, r as rank, case when r < floor(n * 949 / 1000 + 0.5) then 'train' when r < floor(n * 999 / 1000 + 0.5) then 'valid' else 'test' end as split from (select doc_id, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from documents)")
def split_949_50_1(spark, sf):
    return split.by_ranges(docs(spark, sf).select("doc_id"))


# ---- ciphers -----------------------------------------------------------------------------------------


def _poly(key_length):
    return lambda spark, sf: docs(spark, sf).select("doc_id", cipher.poly(F.col("text"), key_length, SEED).alias("text"))


for _k, _name in ((1, "k1"), (100, "k100"), (10_000, "k10000"), (0, "max")):
    query(f"poly_encrypt_{_name}", f"select doc_id, {poly_sql('text', _k)} as text from documents")(_poly(_k))


@query("poly_roundtrip", "select doc_id, true as same from documents")
def poly_roundtrip(spark, sf):
    back = cipher.unpoly(cipher.poly(F.col("text"), 100, SEED), 100, SEED)
    return docs(spark, sf).select("doc_id", back.eqNullSafe(F.col("text")).alias("same"))


@query("chacha20_encrypt")
def chacha20_encrypt(spark, sf):
    key, nonce = cipher.seeded_bytes(SEED, 32), cipher.seeded_bytes(SEED, 8)
    return docs(spark, sf).select("doc_id", cipher.chacha20(F.col("text"), key, nonce).alias("text"))


GRID = (1, 10, 100, 1000, 10_000, 100_000, 0)


@query("cipher_grid_stats", " union all ".join(f"select {k}::INT as key_length, count(*) as n_docs, sum(length(x))::BIGINT as n_chars, sum({HASH32.format('x')})::BIGINT as checksum from (select {poly_sql('text', k)} as x from documents where length(text) > 0)" for k in GRID))
def cipher_grid_stats(spark, sf):
    # one scan: each text is enciphered with every key in its task, and only sums move
    d = docs(spark, sf).where(t.nonempty(F.col("text"))).select(*[cipher.poly(F.col("text"), k, SEED).alias(f"x{k}") for k in GRID])
    d = d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key_length"), F.length(f"x{k}").alias("n"), t.hash32(F.col(f"x{k}")).alias("h")) for k in GRID])).alias("s"))
    return d.groupBy("s.key_length").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("s.n").alias("n_chars"), F.sum("s.h").alias("checksum"))


_ALPHABET = r"[\x20-\x7E\x{A0}-\x{AC}\x{AE}-\x{24F}]"


@query("alphabet_coverage", f"select lang, sum(length(text))::BIGINT as n_chars, sum(len(regexp_extract_all(text, '{_ALPHABET}')))::BIGINT as n_inside from documents group by lang")
def alphabet_coverage(spark, sf):
    inside = F.regexp_count("text", F.lit(_ALPHABET)).cast("long")
    return docs(spark, sf).groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("n_chars"), F.sum(inside).alias("n_inside"))


# ---- vocabularies, tokens, samples -------------------------------------------------------------------

_CHARS = "(select unnest(string_split(text, '')) as ch from documents)"
_FREQ = f"(select w as word, count(*) as n from (select unnest({WORDS}) as w from documents) group by w)"


@query("char_frequency", f"select ch, count(*) as n from {_CHARS} where ch <> '' group by ch")
def char_frequency(spark, sf):
    return corpus.char_frequency(docs(spark, sf))


@query("word_frequency", f"select word, n from {_FREQ}")
def word_frequency(spark, sf):
    return corpus.word_frequency(docs(spark, sf))


@query("char_coverage_alphabet", f"select ch, n, before::BIGINT as before from (select ch, n, coalesce(sum(n) over (order by n desc, ch rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total from (select ch, count(*) as n from {_CHARS} where ch <> '' group by ch)) where before < 0.9995 * total")
def char_coverage_alphabet(spark, sf):
    return corpus.covering_alphabet(docs(spark, sf))


@query("sentence_length_filter", "select doc_id, strlen(text)::BIGINT as n_bytes from documents where length(text) > 0 and strlen(text) <= 4192")
def sentence_length_filter(spark, sf):
    return corpus.training_sentences(docs(spark, sf)).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


_VOCAB = f"(select word, row_number() over (order by n desc, word) + {len(corpus.SPECIAL) - 1} as id from {_FREQ} where word not in ({', '.join(repr(s) if s != chr(10) else 'chr(10)' for s in corpus.SPECIAL)}) order by n desc, word limit {32_000 - len(corpus.SPECIAL)})"
_TOKENS = f"""(select doc_id, list_append(coalesce(list(coalesce(id, {corpus.UNKNOWN}) order by pos) filter (pos is not null), []), {corpus.EOD}) as ids from (select d.doc_id, p.pos, v.id from documents d left join
  (select doc_id, unnest({WORDS}) as word, generate_subscripts({WORDS}, 1) as pos from documents) p using (doc_id) left join {_VOCAB} v using (word)) group by doc_id)"""


def _tokens(spark, sf):
    d = docs(spark, sf)
    return corpus.tokenised(d, corpus.vocabulary(d))


@query("tokenize_append_eod", f"select doc_id, len(ids)::BIGINT as n_tokens, md5(array_to_string(ids, ' ')) as digest from {_TOKENS}")
def tokenize_append_eod(spark, sf):
    return _tokens(spark, sf).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), _md5(F.array_join("token_ids", " ")).alias("digest"))


@query("pack_sequences", f"select sample_id, md5(string_agg(id::VARCHAR, ' ' order by place)) as digest from (select id, (row_number() over (order by doc_id, pos) - 1) as place, (row_number() over (order by doc_id, pos) - 1) // 2048 as sample_id from (select doc_id, unnest(ids) as id, generate_subscripts(ids, 1) as pos from {_TOKENS})) group by sample_id having count(*) = 2048")
def pack_sequences(spark, sf):
    d = docs(spark, sf)
    return corpus.packed_texts(d, corpus.vocabulary(d), form=corpus.as_digests, kind="digest string")


@query("epoch_plan", f"""select n as tokens_per_epoch, (n - 1) // 2048 as samples_per_epoch, e as epochs, case when e = 1 then 5000 else 5000 - ((e - 1) * n - 1) // 2048 end as last_epoch_samples,
  case when e = 1 then 5000 else 5000 - ((e - 1) * n - 1) // 2048 end < 0.8 * ((n - 1) // 2048) as separate_last_epoch from (select n, ceil((5000 * 2048 + 1) / n)::BIGINT as e from (select (sum({NWORDS}) + count(*))::BIGINT as n from documents))""")
def epoch_plan(spark, sf):
    n = docs(spark, sf).agg((F.sum(t.word_count(F.coalesce("text", F.lit("")))) + F.count(F.lit(1))).alias("tokens_per_epoch"))
    return n.select("tokens_per_epoch", *corpus.epoch_plan(F.col("tokens_per_epoch"), 5000))


@query("blend_weights", "select source, sum(strlen(text))::BIGINT as n_bytes, round(sum(strlen(text)) / sum(sum(strlen(text))) over (), 9) as weight from documents group by source")
def blend_weights(spark, sf):
    return corpus.blend_weights(docs(spark, sf)).withColumn("weight", F.round("weight", 9))


@query("render_chat", "select conv_id, count(*) as n_turns, string_agg(case role when 'user' then '### Human: ' when 'assistant' then '### Assistant: ' else '### ' || role || ': ' end || coalesce(text, ''), chr(10) order by turn) as text from conversations group by conv_id")
def render_chat(spark, sf):
    return corpus.rendered_chats(table(spark, sf, "conversations"))


@query("stage_manifest", f"select case part when 'encrypt' then 1 else 2 end as stage, part, source, count(*) as n_docs, sum(length(text))::BIGINT as n_chars from (select *, {_PART} as part from documents where length(text) > 0) group by part, source")
def stage_manifest(spark, sf):
    d = split.bernoulli(docs(spark, sf), 0.9, SEED).groupBy("part", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text").cast("long")).alias("n_chars"))
    return d.select(F.when(F.col("part") == "encrypt", 1).otherwise(2).alias("stage"), "part", "source", "n_docs", "n_chars")


# ---- privacy and scores ------------------------------------------------------------------------------


@query("privacy_sentences", f"select doc_id, pos::INT as pos, text, array_to_string(persons, '|') as persons from {PRIVACY}")
def privacy_sentences(spark, sf):
    return privacy.privacy_sentences(docs(spark, sf)).withColumn("persons", F.array_join("persons", "|"))


@query("person_frequency", f"select person, count(*) as n from (select unnest(persons) as person from {PRIVACY}) group by person")
def person_frequency(spark, sf):
    return privacy.person_frequency(privacy.privacy_sentences(docs(spark, sf)))


@query("privacy_first_n", f"select doc_id, pos::INT as pos, text from {PRIVACY} order by doc_id, pos limit 1000")
def privacy_first_n(spark, sf):
    return privacy.first_sentences(privacy.privacy_sentences(docs(spark, sf))).select("doc_id", "pos", "text")


_ITEMS = f"(select doc_id || '-' || pos as item, text from {PRIVACY} order by md5('{SEED}:' || doc_id || '-' || pos), item limit 1000)"


@query("privacy_testset", " union all ".join([f"select item, null::INT as key_length, text from {_ITEMS}", *(f"select item, {k}::INT, {poly_sql('text', k, longest=20_000)} from {_ITEMS}" for k in (1, 100, 10_000, 0))]))
def privacy_testset(spark, sf):
    return privacy.test_set(cut(privacy.privacy_sentences(docs(spark, sf)).drop("persons"), "privacy"), seed=SEED)


_SIM = "round(1 - levenshtein({0}, {1}) / nullif(greatest(length({0}), length({1})), 0), 9)"


@query("levenshtein_similarity", f"select item_id, {_SIM.format('text', 'b')} as sim from (select *, replace(text, 'th', 't') as b from benchmark)")
def levenshtein_similarity(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.round(t.similarity(F.col("text"), F.replace("text", F.lit("th"), F.lit("t"))), 9).alias("sim"))


@query("prompt_continuation_split", f"select doc_id, array_to_string(w[1 : ceil(len(w) / 2)::BIGINT], ' ') as prompt, array_to_string(w[ceil(len(w) / 2)::BIGINT + 1 :], ' ') as target from (select doc_id, {WORDS} as w from documents) where len(w) >= 2")
def prompt_continuation_split(spark, sf):
    d = docs(spark, sf).select("doc_id", F.explode(F.array(t.words(F.coalesce("text", F.lit(""))))).alias("w")).where(F.size("w") >= 2)  # no filter goes below explode, so words are cut once
    prompt, target = scoring.prompt_split(F.col("w"))
    return d.select("doc_id", F.array_join(prompt, " ").alias("prompt"), F.array_join(target, " ").alias("target"))


#: What stands for generated text: the target itself changed in three ways (of one-byte characters, as DuckDB compares bytes).
_MODELS = ("lower(target)", "replace(target, 'e', '')", "replace(target, 'n', 'm')")


@query("leakage_score", f"""select model, count(sim) as n, round(avg(sim), 9) as mean_sim from (select model, 1 - levenshtein(target, g) / nullif(greatest(length(target), length(g)), 0) as sim from ({" union all ".join(f"select {i}::INT as model, target, {m} as g from (select array_to_string(w[ceil(len(w) / 2)::BIGINT + 1 :], ' ') as target from (select {WORDS} as w from benchmark) where len(w) >= 2)" for i, m in enumerate(_MODELS))})) group by model""")
def leakage_score(spark, sf):
    d = table(spark, sf, "benchmark").select("item_id", t.words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") >= 2)
    d = d.select(F.col("item_id").alias("item"), F.array_join(scoring.prompt_split(F.col("w"))[1], " ").alias("target"))
    pairs = d.select("item", "target", F.posexplode(F.array(*map(F.expr, _MODELS))).alias("model", "generated"))
    return scoring.leakage(pairs).withColumn("mean_sim", F.round("mean_sim", 9))


_NLL = f"""(select place, -ln(c / total) as nll from (select word, row_number() over (order by doc_id, pos) - 1 as place, count(*) over (partition by word) as c, count(*) over () as total from (select doc_id, unnest({WORDS}) as word, generate_subscripts({WORDS}, 1) as pos from documents)))"""
_WINDOWS = f"(select case when place < 1024 then 0 else (place - 1024) // 512 + 1 end as w, count(*) as n_tokens, avg(nll) as nll from {_NLL} group by w)"


@query("perplexity_windows", f"select w::BIGINT as window, n_tokens, round(nll, 9) as nll from {_WINDOWS}")
def perplexity_windows(spark, sf):
    return scoring.unigram_windows(docs(spark, sf)).withColumn("nll", F.round("nll", 9))


@query("perplexity", f"select count(*) as n_windows, round(exp(avg(nll)), 6) as ppl from {_WINDOWS}")
def perplexity(spark, sf):
    return scoring.perplexity(scoring.unigram_windows(docs(spark, sf))).withColumn("ppl", F.round("ppl", 6))


# ---- flagship ----------------------------------------------------------------------------------------


@query("encipher_job", f"select part, lang, count(*) as n_docs, sum(length(x))::BIGINT as n_chars, sum({HASH32.format('x')})::BIGINT as checksum from (select lang, part, case part when 'encrypt' then {poly_sql('text', 100)} else text end as x from (select *, {_PART} as part from documents where length(text) > 0)) group by part, lang")
def encipher_job(spark, sf):
    """Non-empty documents, split; the larger part enciphered; summed by part and language."""
    d = split.bernoulli(docs(spark, sf), 0.9, SEED)
    d = d.withColumn("x", F.when(F.col("part") == "encrypt", cipher.poly(F.col("text"), 100, SEED)).otherwise(F.col("text")))
    return d.groupBy("part", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("x").cast("long")).alias("n_chars"), F.sum(t.hash32(F.col("x"))).alias("checksum"))
