"""SQL for the queries of this subpackage that SQL can express (DuckDB)."""

from __future__ import annotations

OP1 = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, r) as (select vec_id, vec_id from v union select reach.id, p.b from reach join p on reach.r = p.a),
component as (select id, min(r) as c from reach group by id), links as (select a, count(*) as n from p group by a)
select m.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, m.vec_id) as component_id, coalesce(c, m.vec_id) = m.vec_id as kept
from embeddings m left join component on m.vec_id = id left join links on m.vec_id = a
"""

OP7 = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d
), n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
p as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * both_ >= 80 * (x.n + y.n - both_)),
reach(id, r) as (select doc_id, doc_id from n union select reach.id, p.b from reach join p on reach.r = p.a),
component as (select id, min(r) as c from reach group by id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component.c, d.doc_id) as component_id from d left join n using (doc_id) left join component on id = d.doc_id
"""

OP9 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m as (
  select *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '\[/?(?:INST|SYS|OUT|ROLE)\]')) + len(regexp_extract_all(text, '</?s>')) as shown,
    case role when 'system' then 13 when 'user' then 15 when 'assistant' then 6 else 14 + length(role) end + 7 as marks,
    case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'x' end as code
  from t
), g as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as learned, sum(shown + marks)::bigint as formatted_chars, string_agg(code, '' order by turn, role, text) as codes
  from m group by conv_id
), v as (select *, length(regexp_extract(codes, '^s?(ua)*u?')) as fits from g)
select conv_id, n_turns, turns_sha256, length(learned)::bigint as loss_chars, sha256(learned) as loss_sha256, formatted_chars,
  regexp_full_match(codes, 's?(ua)+') as order_ok, case when fits < n_turns then fits::int end as first_violation
from v
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1, "op7_ngram_join": OP7, "op9_chat_formatting": OP9}
