"""DuckDB SQL for the operators that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

import string

from tidemark.llm import hard_negatives as mining
from tidemark.llm import url_filter as urls
from tidemark.llm import vector_codes as codes

SQL: dict[str, str] = {}

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_WORD = r"'[^\x20\x09-\x0D]+'"

SQL["op3_near_dups"] = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) as w from documents),
 s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
   else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as g from d),
 n as (select doc_id, len(g) as n, md5(array_to_string(list_sort(g), chr(10))) as whole from s),
 classes as (select whole, min(doc_id) as class_id, count(*) as n_class, any_value(n) as n from n where n > 0 group by 1),
 each as (select c.class_id as a, c.n, md5_number(v) as v from classes c join (select doc_id, unnest(g) as v from s) on doc_id = c.class_id),
 shared as (select x.a, y.a as b, count(*) as c, any_value(x.n + y.n) as total from each x join each y on x.v = y.v and x.a < y.a group by 1, 2),
 links as (select a, b from shared where 100 * c >= 75 * (total - c)),
 sides as (select a, b from links union all select b, a from links),
 reach as (select class_id as a, class_id as r from classes union select reach.a, sides.b from reach join sides on sides.a = reach.r),
 roots as (select a as class_id, min(r) as root from reach group by 1)
select doc_id, n.n as n_shingles, coalesce(root, doc_id) as component_id, doc_id = coalesce(root, doc_id) as kept, coalesce(class_id, doc_id) as class_id, n_class
from n left join classes using (whole) left join roots using (class_id)"""


def _url_filter() -> str:
    """The template tree, a level after the other; constants as in the operator."""
    steps, before = [], "t0"
    for k in range(1, urls.DEPTH + 1):
        last = k == urls.DEPTH
        part = f"case when len(parts) > {k} then array_to_string(parts[{k + 1}:], '/') end" if last else f"parts[{k + 1}]"
        steps.append(
            f"""s{k} as (select *, {part} as segment from {before}),
 c{k} as (select host, template, segment, count(*) as n, count(bad) as seen, coalesce(sum(bad), 0)::double as worse from s{k} where segment is not null group by 1, 2, 3),
 p{k} as (select *, sum(n) over w as all_n, sum(seen) over w as all_seen, sum(worse) over w as all_worse from c{k} window w as (partition by host, template)),
 z{k} as (select *, abs(worse / nullif(seen, 0) - (all_worse - worse) / nullif(all_seen - seen, 0)) as gap, all_worse / nullif(all_seen, 0) as pooled from p{k} where n >= {urls.MIN_SHARE}::double * all_n),
 o{k} as (select host, template, segment, true as own from z{k} where gap / nullif(sqrt(pooled * (1 - pooled) * (1.0::double / nullif(seen, 0) + 1.0::double / nullif(all_seen - seen, 0))), 0) >= {urls.MERGE_Z}),
 t{k} as (select page_id, host, path, parts, bad, template || case when segment is null then '' when own then '/' || segment else '/*' end as template from s{k} left join o{k} using (host, template, segment))"""
        )
        before = f"t{k}"
    rules = sorted(urls.RULES, key=lambda r: -len(r[1]))
    fits = {t: f"((host = '{t.split('/')[0]}' or host like '%.{t.split('/')[0]}') and path like '/{t.partition('/')[2]}%')" for _, t in rules}
    rule = " ".join(f"when {fits[t]} then '{t}'" for _, t in rules)
    verdict = " ".join(f"when {fits[t]} then '{v}'" for v, t in rules)
    steps = ",\n ".join(steps)
    return rf"""
with known as (select doc_id as page_id, max(case when quality = 0 then 1 else 0 end) as bad from labels where doc_id is not null and quality is not null group by 1),
 u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
 t0 as (select page_id, host, path, string_split(path, '/') as parts, bad, '' as template from u left join known using (page_id)),
 {steps},
 bt as (select host, template, count(bad) as seen, coalesce(sum(bad), 0)::double as worse from {before} group by 1, 2),
 bh as (select *, sum(seen) over w as host_seen, sum(worse) over w as host_worse, coalesce(sum(worse) over () / nullif(sum(seen) over (), 0), 0) as rate from bt window w as (partition by host)),
 scored as (select host, template, (worse + {urls.PRIOR} * ((host_worse + {urls.PRIOR} * rate) / (host_seen + {urls.PRIOR}))) / (seen + {urls.PRIOR}) as badness from bh)
select page_id, host, path, case {rule} end as rule, case {verdict} when badness >= {urls.REJECT} then 'block' else 'allow' end as verdict, template, round(badness, 9) as badness
from {before} join scored using (host, template)"""


SQL["op4_url_filter"] = _url_filter()

SQL["op6_suffix_dedup"] = """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
 g as (select doc_id, generate_subscripts(h, 1) as i, unnest(h) as h from (
   select doc_id, list_transform(range(1, octet_length(b) - 198), lambda i: md5_number(array_slice(b, i, i + 199))) as h from d)),
 again as (select doc_id, i, 1 as hit from (select *, count(*) over (partition by h) as n from g) where n > 1),
 bytes as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as x from (select doc_id, regexp_extract_all(hex(b), '..') as x from d)),
 marked as (select doc_id, i, x, coalesce(max(hit) over (partition by doc_id order by i rows between 199 preceding and current row), 0) as gone from bytes left join again using (doc_id, i)),
 edged as (select *, lag(gone, 1, 0) over (partition by doc_id order by i) as before from marked),
 sums as (select doc_id, sum(gone)::bigint as n_removed, count(*) filter (where gone = 1 and before = 0) as n_spans, sha256(unhex(coalesce(string_agg(x, '' order by i) filter (where gone = 0), ''))) as kept_sha256 from edged group by 1)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join sums using (doc_id)"""

SQL["op7_mixing"] = rf"""
with q as (select doc_id, case max(quality) when 1 then 1.0::double when 0 then 0.25 else 0.75 end as weight from labels where doc_id is not null group by 1),
 d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::bigint as size,
   -ln((('0x' || substring(md5(doc_id::varchar), 1, 13))::bigint + 0.5::double) / 4503599627370496) / coalesce(weight, 0.75) as key from documents left join q using (doc_id)),
 s as (select source, sum(size)::bigint as source_size, [5.0::double, 2, 1][((row_number() over (order by source nulls last) - 1) % 3) + 1] as w from d group by 1),
 a as (select *, row_number() over l as rn, (sum(source_size) over () * 1.5::double - coalesce(sum(2.0::double * source_size) over (order by 2.0 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
   / sum(w) over (order by 2.0 * source_size / w, source nulls last rows between current row and unbounded following) as height from s window l as (order by 2.0 * source_size / w, source nulls last)),
 lines as (select min_by(height, rn) as line from a where height <= 2.0 * source_size / w),
 t as (select source, source_size, least(2.0 * source_size, coalesce(line * w, 2.0 * source_size)) as target from a cross join lines),
 p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
 o as (select d.doc_id, d.size, p.*, coalesce(sum(size) over (partition by d.source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as before from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, round(target, 6) as target, (size * (epochs + case when 2 * before + size <= 2 * (target - epochs * source_size) then 1 else 0 end))::bigint as taken from o"""

SQL["op9_reference_dedup"] = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents),
 g as (select doc_id, generate_subscripts(h, 1) as i, unnest(h) as h from (
   select doc_id, list_transform(range(1, len(w) - 18), lambda i: md5_number(array_to_string(w[i:i+19], ' '))) as h from d)),
 again as (select doc_id, i, 1 as hit from (select *, row_number() over (partition by h order by doc_id, i) as nth from g) where nth > 1),
 words as (select doc_id, generate_subscripts(w, 1) as i, unnest(w) as word from d),
 marked as (select doc_id, i, word, coalesce(max(hit) over (partition by doc_id order by i rows between 19 preceding and current row), 0) as gone from words left join again using (doc_id, i)),
 sums as (select doc_id, sum(gone)::bigint as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (where gone = 0), '')) as kept_sha256 from marked group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join sums using (doc_id)"""


def _vector_codes() -> str:
    """Lloyd's rounds with all distances, a round after the other."""
    steps = []
    for k in range(codes.ROUNDS + 1):
        far = "list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - b.x[i]) * (x.x[i] - b.x[i])))::bigint"
        steps.append(f"a{k} as materialized (select r, p, min(struct_pack(d := {far}, e := e)) as best, any_value(x.x) as x from x join b{k} b using (p) group by 1, 2)")
        if k < codes.ROUNDS:
            steps.append(
                f"""m{k} as (select p, e, list(v order by i) as x from (
   select p, best.e as e, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::bigint as v from a{k}, unnest(range(1, len(x) + 1)) u(i) group by 1, 2, 3) group by 1, 2),
 b{k + 1} as materialized (select p, e, coalesce(m{k}.x, b{k}.x) as x from b{k} left join m{k} using (p, e))"""
            )
    steps = ",\n ".join(steps)
    return f"""
with kept as materialized (select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::double)::bigint) as v
   from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 size as (select (max(len(v)) + {codes.PARTS - 1}) // {codes.PARTS} as n from kept),
 x as materialized (select r, p, v[p * n + 1 : p * n + n] as x from kept cross join size, unnest(range({codes.PARTS})) u(p)),
 b0 as materialized (select p, r - 1 as e, x from x where r <= {codes.ENTRIES}),
 {steps},
 coded as (select r, string_agg(format('{{:02x}}', best.e), '' order by p) as code, sum(best.d)::bigint as error from a{codes.ROUNDS} group by 1),
 whole as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from b{codes.ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join coded using (r) cross join whole"""


SQL["op11_vector_codes"] = _vector_codes()

SQL["op13_hard_negatives"] = f"""
with r as materialized (select row_number() over () as r, vec_id, case when vec_id % {mining.SHIFTED} = 0 then (label + 1) % {mining.LABELS} else label end as label,
   list_transform(embedding, lambda x: floor({mining.SCALE} * x::double)::bigint) as v
   from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 s as materialized (select a.r as anchor, a.vec_id as anchor_id, b.r as other, b.vec_id, a.label = b.label as same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score
   from r a join r b on a.vec_id % {mining.EVERY} = 0 and a.r <> b.r),
 p as (select anchor, anchor_id, vec_id as positive_id, score as positive_score, nth from (
   select *, row_number() over (partition by anchor order by score desc, vec_id) as nth from s where same) where nth <= {mining.K}),
 n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor, nth order by s.score desc, s.vec_id) as rank
   from p join s on s.anchor = p.anchor and not same and {mining.LOW} * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= {mining.K}"""
