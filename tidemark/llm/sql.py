"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .secrets import KINDS, MAX_OWNERS, MAX_REPOSITORIES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
l as (select r, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key from l),
f as (select key, max(doc_id) as last from (select distinct r, doc_id, key from k where length(key) >= 40) group by key having count(*) >= 5),
m as (select k.*, coalesce(doc_id < last, false) as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by r, doc_id
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_SHAPES = (
    (f"(?:{_NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, "length(v) >= 8"),
    ("AKIA[A-Z0-9]+", 0, "length(v) >= 16"),
    ("[0-9a-f]{32,}", 0, "true"),
    (
        "[A-Za-z0-9+/_=-]{24,}",
        0,
        "regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')",
    ),
)


def _found(kind: int) -> str:
    pattern, group, keep = _SHAPES[kind]
    total = "coalesce(list_sum(list_transform({}, lambda y: length(y))), 0)"
    return f"""
x{kind} as (select r, owner, repo, regexp_extract_all(text, '{pattern}', 0) as m, regexp_extract_all(text, '{pattern}', {group}) as v,
            regexp_split_to_array(text, '{pattern}') as p from d where regexp_matches(text, '{pattern}')),
s{kind} as (select r, owner, repo, {kind} as kind, z.a as st, z.a + length(z.m) as en, z.v as v from (select r, owner, repo, unnest(list_transform(range(1, len(m) + 1),
            lambda i: {{'a': {total.format("p[1:i]")} + {total.format("m[1:i-1]")}, 'm': m[i], 'v': v[i]}})) as z from x{kind}) where {keep.replace("(v", "(z.v")})"""


_NAME = "case kind " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
_SHOWN = f"string_agg({_NAME} || ':' || st || ':' || en, ',' order by st, kind)"
SECRETS = f"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as owner, coalesce(source, '') || '/' || coalesce(lang, '') as repo, coalesce(text, '') as text from documents),
{",".join(_found(k) for k in range(4))},
every as (select * from s0 union all select * from s1 union all select * from s2 union all select * from s3),
fr as (select v, count(distinct owner) as owners, count(distinct repo) as repos from every group by v),
j as (select every.*, owners, repos, owners <= {MAX_OWNERS} and repos <= {MAX_REPOSITORIES} as live from every join fr on every.v = fr.v),
g as (select r, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
      {_SHOWN} filter (where kind < 3) as base, {_SHOWN} filter (where kind < 3 or live) as spans,
      count(*) filter (where kind = 3 and live) as n_bare, count(*) filter (where kind < 3 and live) as n_live, count(*) filter (where kind < 3 and not live) as n_copied,
      max(owners) filter (where kind < 3) as most_owners, max(repos) filter (where kind < 3) as most_repositories
      from j group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_bare, 0) as n_bare, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied, coalesce(most_owners, 0) as most_owners, coalesce(most_repositories, 0) as most_repositories
from d left join g on d.r = g.r
"""
