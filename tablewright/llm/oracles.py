"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tablewright.llm.quality_rules import CUTOFFS, RATIOS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_CUTS = ", ".join(str(c) for c in CUTOFFS)
_RULES = ", ".join(f"('{name}')" for name in RATIOS)
_RATIO = "case rule " + " ".join(f"when '{name}' then {sql}" for name, sql in RATIOS.items()) + " end"

OP1 = rf"""
with d as (select doc_id, coalesce(lang, '') stratum, coalesce(text, '') t, {_WORDS} ws from documents),
w as (select doc_id, p, hash(list_aggregate(ws[p:p+4], 'string_agg', ' ')) g, list_aggregate(ws[p:p+4], 'string_agg', ' ') s from (select doc_id, ws, unnest(range(1, len(ws) - 3)) p from d)),
r as (select doc_id, p from (select *, count(*) over (partition by doc_id, s) c from w) where c > 1),
n as (select doc_id, count(distinct p + o) n_repeat_words from r, range(0, 5) q(o) group by 1),
l as (select doc_id, count(*) n_lines, count(*) - count(distinct line) n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select d.doc_id, stratum, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
  coalesce(n_lines, 0) n_lines, coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words, len(regexp_extract_all(t, '!'))::bigint n_exclaims
  from d left join n using (doc_id) left join l using (doc_id)),
x as (select m.doc_id, stratum, rule, {_RATIO} ratio from m, (values {_RULES}) v(rule)),
good as (select doc_id from labels group by 1 having min(quality) = 1),
k as (select stratum, rule, cutoff, count(*) n, count(*) filter (where ratio > cutoff) k from x join good using (doc_id), unnest([{_CUTS}]) c(cutoff) group by all),
b as (select *, (select count(distinct stratum) from k) strata, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({0.02 / len(RATIOS)!r}) + (n - j) * ln(1 - {0.02 / len(RATIOS)!r})))) tail from k),
c as (select stratum, rule, min(cutoff) cutoff from b where tail <= 0.05 / (strata * {len(RATIOS)} * {len(CUTOFFS)}) group by all),
h as (select x.doc_id, string_agg(rule, ',' order by array_position([{", ".join(f"'{name}'" for name in RATIOS)}], rule)) hits from x join c using (stratum, rule) where ratio > cutoff group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and hits is null kept, coalesce(hits, '') rules_hit from m left join h using (doc_id)"""

OP2 = rf"""
with d as (select doc_id, {_WORDS} ws from documents), w as (select doc_id, ws, unnest(range(1, len(ws) - 18)) p from d),
g as (select doc_id, p, list_aggregate(ws[p:p+19], 'string_agg', ' ') s from w), o as (select *, row_number() over (partition by s order by doc_id, p) k from g),
gone as (select distinct doc_id, p + q i from o, range(0, 20) r(q) where k > 1),
u as (select doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) i from d)
select d.doc_id, len(ws)::bigint n_words, count(gone.i)::bigint n_removed, sha256(coalesce(string_agg(word, ' ' order by u.i) filter (where gone.i is null), '')) kept_sha256
from d left join u using (doc_id) left join gone on gone.doc_id = u.doc_id and gone.i = u.i group by d.doc_id, ws"""

OP7 = rf"""
with d as (select doc_id, source, len({_WORDS})::bigint size, md5('mix|' || doc_id::varchar) h, md5(coalesce(text, '')) k from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source is null, source) - 1 o from d group by source),
c as (select *, ([3.0, 1.0, 2.0]::double[])[(o % 3 + 1)::int] weight, source_size::double * 2.0::double cap from s),
f as (select *, sum(source_size) over ()::double * 1.5::double pool, coalesce(sum(cap) over (order by cap / weight, o rows between unbounded preceding and 1 preceding), 0) filled,
  sum(weight) over (order by cap / weight, o rows between current row and unbounded following) open from c),
v as (select *, max(case when (pool - filled) / open <= cap / weight then (pool - filled) / open end) over () level from f),
t as (select source, o, source_size, least(cap, coalesce(level, 'infinity'::double) * weight) target from v),
q as (select *, floor(target + 0.5)::bigint taking from t), n as (select o, ((taking + 1023) // 1024)::bigint slots from q),
w as (select o, slots, coalesce(sum(slots) over (order by o rows between unbounded preceding and 1 preceding), 0)::bigint low, sum(slots) over () total from n),
b as (select o, unnest(range(low, low + slots)) point, greatest(1, length(bin((greatest(total, 1) - 1)::bigint))) bits from w),
g as (select o, list_sum(list_transform(range(0, bits), lambda j: ((point >> j) & 1) * (1::bigint << (bits - 1 - j))))::bigint slot from b),
e as (select o, slot, row_number() over (partition by o order by slot) - 1 r from g),
x as (select doc_id, q.o, size, q.source_size, target, taking, coalesce(sum(size) over (partition by d.source order by h, doc_id, size, k rows between unbounded preceding and 1 preceding), 0)::bigint a
  from d join q on d.source is not distinct from q.source),
l as (select *, a + lap * source_size f, least(a + lap * source_size + size, taking) u from x, (values (0), (1)) y(lap)),
p as (select doc_id, sum(least(u, (r + 1) * 1024) - greatest(f, r * 1024))::bigint taken, min(slot) first_slot from l join e on l.o = e.o and r >= f // 1024 and r <= (u - 1) // 1024 where size > 0 and f < u group by 1)
select x.doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken, first_slot from x left join p using (doc_id)"""

OP8 = """
with recursive e as (select vec_id, label, embedding::double[] v from embeddings where label is not null and embedding is not null),
p as (select a.vec_id a, b.vec_id b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93),
r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a),
c as (select vec_id, least(vec_id, min(r.b)) component_id from embeddings left join r on r.a = vec_id group by vec_id),
n as (select a, count(*) n from p group by 1)
select c.vec_id, coalesce(n, 0)::bigint n_links, component_id, c.vec_id = component_id kept from c left join n on n.a = c.vec_id"""

ORACLES = {"op1_quality_rules": OP1, "op2_substring_dedup": OP2, "op7_source_mix": OP7, "op8_rp_forest": OP8}
