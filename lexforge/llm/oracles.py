"""DuckDB SQL of the queries that SQL can express.

Not here: op1 (a container format), op3, op4 and op10 (hashes that DuckDB has not), op2 (not written: its diagonals
and runs of spans are long in SQL), op6, op7 and op9 (graphs, a fitted model, a tokenizer). ``tests/llm`` holds those against
brute force.
"""

from __future__ import annotations

from .common import WORD
from .secrets import BASE, EXTRA, MAX_OWNERS, MAX_REPOSITORIES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(width: int = 4) -> str:
    grams = f"case when len(w) = 0 then []::VARCHAR[] when len(w) < {width} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i : i + {width} - 1], ' ')) end"
    return f"""
with recursive s as (select distinct doc_id, unnest({grams}) as g from (select doc_id, regexp_extract_all({_LOWER}, '{WORD}') as w from documents)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b),
low as (select a, min(b) as b from reach group by a)
select doc_id, coalesce(n, 0)::BIGINT as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id, doc_id = least(doc_id, coalesce(b, doc_id)) as kept
from documents left join n using (doc_id) left join low on low.a = doc_id"""


def secrets() -> str:
    kinds = []
    for rank, (kind, pattern, group, least) in enumerate(BASE + EXTRA):
        # RE2 looks neither ahead nor behind: the whole run, and then what it must hold
        more = ""
        if kind == "mixed":
            pattern, more = f"[A-Za-z0-9]{{{least},}}", "and regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')"
        p = "'" + pattern.replace("'", "''") + "'"
        at = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)"
        kinds.append(f"""select doc_id, source, lang, {rank} as rank, '{kind}' as kind, start::BIGINT as s, (start + length(m))::BIGINT as e, v from (select doc_id, source, lang, found[i] as m, vals[i] as v, {at} as start from
  (select *, unnest(range(1, len(found) + 1)) as i from (select doc_id, source, lang, string_split_regex(text, {p}) as gaps, regexp_extract_all(text, {p}) as found, regexp_extract_all(text, {p}, {group}) as vals from documents where regexp_matches(text, {p})))) where length(v) >= {least} {more}""")
    base = len(BASE)
    counts = ", ".join(f"count_if(kind = '{k}')::BIGINT as n_{k}" for k, *_ in BASE)
    return f"""
with p as ({" union all ".join(kinds)}),
c as (select v, count(distinct coalesce('=' || source, '')) as owners, count(distinct coalesce('=' || source, '') || chr(10) || coalesce('=' || lang, '')) as repositories from p group by v),
o as (select *, owners <= {MAX_OWNERS} and repositories <= {MAX_REPOSITORIES} as live from c),
j as (select * from p join o using (v)),
d as (select doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < {base}) as b, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < {base} or live) as a, count_if(live)::BIGINT as n_live, count_if(not live)::BIGINT as n_example, max(owners) as mo, max(repositories) as mr from j group by doc_id)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT as n_{k}" for k, *_ in BASE)}, sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans, coalesce(n_live, 0)::BIGINT as n_live, coalesce(n_example, 0)::BIGINT as n_example, coalesce(mo, 0)::BIGINT as most_owners, coalesce(mr, 0)::BIGINT as most_repositories
from documents left join d using (doc_id)"""


ORACLES = {"op5_ownership": secrets(), "op8_bottom_k": near_duplicates()}
