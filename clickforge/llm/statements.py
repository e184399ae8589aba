"""SQL counterparts (DuckDB) of the Merkle manifest, the archives and the clustering."""

from __future__ import annotations

_FIELDS = ", ".join(
    f"coalesce(cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar), '-')"
    for c in ("doc_id", "source", "lang", "n_chars", "{text}")
)
_LEAF = f"sha256(concat({_FIELDS}))"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 of a decimal text, bit by bit
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: ascii(ch)::bigint), lambda acc, b:
  list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(acc, b)), 4294967295::bigint))"""

# nodes of one tree: (g, level, idx, digest, n) with n nodes in the level, all levels up to the last node
_TREE = """{name} as (select g, 0 as level, idx, digest, n from {leaves}
  union all select g, level + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (n + 7) // 8 from {name} where n > 1 group by g, level, idx // 8, n)"""
# where a leaf of a tree stands on each level, with the siblings left and right of it
_STEPS = """{name} as (select l.g, l.idx as leaf, own.level,
    coalesce(string_agg(s.digest, '' order by s.idx) filter (where s.idx < own.idx), '') as lefts,
    coalesce(string_agg(s.digest, '' order by s.idx) filter (where s.idx > own.idx), '') as rights
  from {leaves} l join {tree} own on own.g = l.g and own.idx = l.idx // (8 ** own.level)::bigint and own.n > 1
  join {tree} s on s.g = own.g and s.level = own.level and s.idx // 8 = own.idx // 8 group by all)"""

MERKLE_SQL = f"""
with recursive hashed as (select doc_id, coalesce('=' || lang, '-') as g, {_LEAF.format(text="text")} as digest,
  case when {_CRC} % 3 = 0 then {_LEAF.format(text=_FOLDED)} end as changed from documents),
leaves as (select *, row_number() over (partition by g order by doc_id nulls first, digest) - 1 as idx, count(*) over (partition by g) as n from hashed),
{_TREE.format(name="tree", leaves="leaves")},
tops as (select g, digest from tree where n = 1),
tips as (select '' as g, g as own, digest, row_number() over (order by g) - 1 as idx, count(*) over () as n from tops),
{_TREE.format(name="over", leaves="tips")},
{_STEPS.format(name="low", leaves="leaves", tree="tree")},
{_STEPS.format(name="high", leaves="tips", tree="over")},
steps as (select g, leaf, level, lefts, rights from low
  union all select l.g, l.idx, 1000 + h.level, h.lefts, h.rights from leaves l join tips t on t.own = l.g join high h on h.leaf = t.idx),
ordered as (select *, row_number() over (partition by g, leaf order by level) as step from steps),
folds as (select doc_id, g, idx, 0 as step, coalesce(changed, digest) as own from leaves
  union all select f.doc_id, f.g, f.idx, f.step + 1, sha256(o.lefts || f.own || o.rights)
  from folds f join ordered o on o.g = f.g and o.leaf = f.idx and o.step = f.step + 1),
proofs as (select g, leaf, sha256(string_agg(lefts || rights, '' order by step)) as proof, max(step) as last from ordered group by g, leaf)
select l.doc_id, l.digest as leaf, t.digest as subroot, r.digest as root, coalesce(p.proof, sha256('')) as proof_sha256, f.own as folded_root,
  f.own = r.digest as verified
from leaves l join tops t on t.g = l.g join over r on r.n = 1 left join proofs p on p.g = l.g and p.leaf = l.idx
join folds f on f.g = l.g and f.idx = l.idx and f.step = coalesce(p.last, 0)
"""

WARC_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as s from pages),
last as (select *, max(page_id) over (partition by s) as response from p)
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(s, (i * 5) // 4 + 1, 2))::int >> (3 - (i * 5) % 4)) & 31) + 1)::int, 1)), '') as payload_digest,
  case when page_id = response then 'response' else 'revisit' end as record_type, case when page_id <> response then response end as refers_to
from last
"""


def cluster_sql(k: int, rounds: int, dim: int, scale: int, seed: str) -> str:
    """All rounds, one after another; vectors and centroids in long form."""
    parts = [f"""
with kept as materialized (select vec_id, embedding from embeddings where len(embedding) = {dim}
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
nums as materialized (select vec_id, unnest(range({dim})) as j,
  unnest(list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint))) as x from kept),
firsts as (select vec_id, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c from kept qualify c < {k}),
cent0 as materialized (select c, j, x as y from firsts join nums using (vec_id))"""]
    for r in range(rounds + 1):
        parts.append(f"""dist{r} as (select vec_id, c, cast(sum((x - y) * (x - y)) as bigint) as d from nums join cent{r} using (j) group by vec_id, c),
near{r} as materialized (select vec_id, c, d from dist{r} qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if r < rounds:
            parts.append(f"""sums{r} as (select c, j, cast(sum(x) as bigint) as s, count(*) as n from near{r} join nums using (vec_id) group by c, j),
cent{r + 1} as materialized (select c, j, coalesce((s - ((s % n + n) % n)) // n, y) as y from cent{r} left join sums{r} using (c, j))""")
    last = rounds
    parts.append(f"""inertia as (select c, cast(sum(d) as bigint) as own, cast(sum(sum(d)) over () as bigint) as total from near{last} group by c),
marks as (select c, sha256(string_agg(cast(y as varchar), ',' order by j)) as mark from cent{last} group by c)""")
    return ",\n".join(parts) + f"""
select vec_id, cast(c as int) as cluster, d as distance, own as cluster_inertia, total as inertia, mark as centroid_sha256
from near{last} join inertia using (c) join marks using (c)"""
