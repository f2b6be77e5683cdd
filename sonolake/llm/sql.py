"""DuckDB SQL for the queries that SQL can express. The others are tested against plain rules in tests/llm."""

from __future__ import annotations

from .licenses import PARAGRAPHS, PHRASES, TEMPLATES, THRESHOLD

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as ws from documents),
places as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13),
k as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as s from places),
f as (select s, min(doc_id) as m from k group by s),
hit as (select k.doc_id, k.i from k join f on k.s = f.s where f.m < k.doc_id),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 13)) as p from hit)),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select words.doc_id, string_agg(word, ' ' order by words.p) as t from words left join gone on words.doc_id = gone.doc_id and words.p = gone.p where gone.p is null group by 1),
n as (select doc_id, count(*) as n from gone group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept on w.doc_id = kept.doc_id left join n on w.doc_id = n.doc_id"""

_OP3 = rf"""with w as (select doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') as ws from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWERED}, '{_ALNUM}') as ws from benchmark),
q as (select item, least(10, len(ws)) as n, array_to_string(ws[i:i + 9], ' ') as s from (select item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) as i from b where len(ws) > 0)),
sizes as (select distinct n from q),
places as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, sizes where len(ws) >= n),
hit as (select distinct k.doc_id, k.i, k.n, q.item from (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as s from places) k join q on k.s = q.s and k.n = q.n),
covered as (select doc_id, count(*) as n from (select distinct doc_id, p from (select doc_id, unnest(range(i, i + n)) as p from hit)) group by 1),
items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as t from (select distinct doc_id, item from hit) group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(covered.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(items.t, '')) as items_sha256, coalesce(covered.n, 0) > 0 as contaminated
 from w left join covered on w.doc_id = covered.doc_id left join items on w.doc_id = items.doc_id"""

_REACH = """ways as (select a, b from links union select b, a from links),
reach as (select a, b from ways union select reach.a, ways.b from reach join ways on reach.b = ways.a),
low as (select a, min(b) as m from reach group by a), n as (select a, count(*) as n from ways group by a)"""

_OP4 = f"""with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id < y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.9), {_REACH}
select vec_id, coalesce(n.n, 0) as n_links, coalesce(least(low.m, vec_id), vec_id) as component_id, coalesce(least(low.m, vec_id), vec_id) = vec_id as kept from v left join low on vec_id = low.a left join n on vec_id = n.a"""

_OP5 = rf"""with recursive w as (select doc_id, regexp_extract_all({_LOWERED}, '{_SPACED}') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0)),
c as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from p join c ca on a = ca.doc_id join c cb on b = cb.doc_id where 100 * k >= 90 * (ca.n + cb.n - k)), {_REACH}
select w.doc_id, coalesce(c.n, 0) as n_shingles, coalesce(least(low.m, w.doc_id), w.doc_id) as component_id, coalesce(n.n, 0) as n_links from w left join c on w.doc_id = c.doc_id left join low on w.doc_id = low.a left join n on w.doc_id = n.a"""

_PHRASES = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"('{kind}', '{label}', {sorted(set(text.split()))!r})" for kind, own in (("sentence", TEMPLATES), ("paragraph", PARAGRAPHS)) for label, text in own)
_PLAIN = rf"regexp_replace(regexp_replace({_LOWERED}, '[!?;]', '.', 'g'), '[\x00-\x09\x0B-\x2D\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g')"
_OP7 = rf"""with w as (select doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') as ws from documents), ph(phrase, label, k) as (values {_PHRASES}),
places as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w where len(ws) > 0),
hit as (select doc_id, i - 1 as i, label from places, ph where array_to_string(ws[i:i + k - 1], ' ') = phrase),
base as (select doc_id, count(*) as n, min(i) as a, max(i) as z, string_agg(distinct label, ',' order by label) as l from hit group by 1),
paragraphs as (select doc_id, unnest(regexp_split_to_array({_PLAIN}, '\n *\n')) as p from documents),
sentences as (select doc_id, unnest(regexp_split_to_array(p, '\.+')) as p from paragraphs),
blocks as (select doc_id, kind, list_distinct(regexp_extract_all(p, '{_ALNUM}')) as t from (select doc_id, 'sentence' as kind, p from sentences union all select doc_id, 'paragraph', p from paragraphs)),
tp(kind, label, own) as (values {_TEMPLATES}),
near as (select doc_id, label, len(list_intersect(t, own)) / cast(len(own) as double) as c from blocks join tp on blocks.kind = tp.kind where len(t) >= ceil({THRESHOLD} * len(own) - 1e-9) and len(list_intersect(t, own)) >= ceil({THRESHOLD} * len(own) - 1e-9)),
best as (select doc_id, max(c) as c from near group by 1),
labels as (select doc_id, string_agg(distinct label, ',' order by label) as l from (select doc_id, label from hit union select doc_id, label from near) group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(base.n, 0) as n_base, base.a as first_word, base.z as last_word, coalesce(base.l, '') as base_labels, coalesce(labels.l, '') as labels,
 case when base.n > 0 then 1.0 else coalesce(best.c, 0.0) end as score from w left join base on w.doc_id = base.doc_id left join best on w.doc_id = best.doc_id left join labels on w.doc_id = labels.doc_id"""

_OP11 = r"""with t as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
h as (select *, len(u) as n, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2, cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
 case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m, coalesce(array_to_string(u[b + 1:n], ''), '') as s from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from p"""

_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, [ord(x)::bigint for x in string_split(cast(c as varchar), '')]),
 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: case when y % 2 = 1 then xor(y // 2, 3988292384) else y // 2 end)), 4294967295)"""
_OP13 = rf"""with t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as t, turn from conversations where conv_id is not null),
own as (select c, list(struct_pack(r := r, t := t) order by turn is not null, turn, md5(length(r) || ':' || r || t)) as o from t group by c),
h as (select c, o, c - c % 20 as base, {_CRC} % 4 as h from own),
s as (select h.c, list_concat(coalesce(x.o[1:h], []), h.o[h + 1:]) as s from h left join own x on x.c = h.base),
d as (select c, s, unnest(range(0, len(s) + 1)) as d from s),
at_ as (select c, d, d = len(s) as e, s[1:d] as p, case when d > 0 then len(regexp_extract_all(s[d].t, '{_SPACED}')) else 0 end as w from d),
m as (select *, min(c) over (partition by d, p) as m from at_),
n as (select m, d, count(*) as n, any_value(w) as w, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where e), '')) as ends from m group by m, d),
up as (select n.*, m.m as parent from n left join m on m.c = n.m and m.d = n.d - 1),
kids as (select parent as m, d - 1 as d, count(*) as k from up where d > 0 group by 1, 2),
every as (select up.*, coalesce(kids.k, 0) as k from up left join kids on up.m = kids.m and up.d = kids.d),
sums as (select m.m, m.d, sum(case when k = 0 then 1 else 0 end) as leaves, sum((every.n - 1) * every.w) as saved from every join m on m.c = every.m and m.d <= every.d group by 1, 2)
select every.m as conv_id, every.d as depth, every.parent as parent_conv_id, every.n as n_convs, every.k as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, ends as ends_sha256
 from every join sums on every.m = sums.m and every.d = sums.d"""

ORACLE: dict[str, str] = {"op1_substring_dedup": _OP1, "op3_decontaminate": _OP3, "op4_embedding_dedup": _OP4, "op5_ngram_join": _OP5, "op7_license_scan": _OP7, "op11_fill_in_middle": _OP11, "op13_prefix_trie": _OP13}
