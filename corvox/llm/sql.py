"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .interactions import FILTERS, LEAST_DISTINCT, MOST_CAPITALS
from .interactions import LEAST_WORDS as FEWEST_WORDS
from .quality import FENCE, LEAST_WORDS, LIMITS, MEASURES, MODEL, MOST_REPEATED, PER, PRIOR, UNIT, beyond
from .urls import DEFAULT, RULES
from .vectors import ENTRIES, PARTS, ROUNDS, SCALE

OP1 = """with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n from pages), m as (select *, min(page_id) over (partition by h) as first from p)
select page_id, n as payload_bytes, sha256(h) as payload_digest, case when n >= 100 and first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type, case when n >= 100 and page_id is distinct from first then first end as refers_to from m"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
POW = "(1::bigint << (length(bin(x)) - 8))"
BUCKET = f"(case when x < 256 then x else (x // {POW}) * {POW} end)"
RATES = {m: f"{PER} * {count} // greatest({of}, 1)" for m, (count, of) in MEASURES.items()}
SHARE = ", ".join(f"{c} * {PRIOR * UNIT} // total" for c in ("n", "size"))
BEYOND = " or ".join(beyond(*x) for x in LIMITS)

OP2 = rf"""with w as (select doc_id, lang, source, text, {WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, row_number() over () as r from documents),
v as (select r, i, w[i:i + 4] as win from w, lateral (select unnest(range(1, len(w) - 3)) as i)), t as (select r, i from (select r, i, count(*) over (partition by r, win) as c from v) where c > 1),
k as (select r, count(distinct i + j) as n from t, (values (0), (1), (2), (3), (4)) o(j) group by 1),
b as (select doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(k.n, 0)::bigint as n_repeat_words from w left join k using (r)),
m as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from b),
x as ({" union all ".join(f"select '{m}' as measure, lang, source, {RATES[m]} as x, greatest({MEASURES[m][1]}, 1) as of_ from m where not base_failed" for m in MEASURES)}),
sketch as (select measure, lang, source, {BUCKET} as bucket, count(*) as n, sum(of_) as size from x group by all), g as (select distinct measure, lang, source from sketch),
l as (select *, sum(n) over (partition by measure, lang) as total from (select measure, lang, bucket, sum(n) as n, sum(size) as size from sketch group by all)), c as (select *, sum(n) over (partition by measure) as total from (select measure, bucket, sum(n) as n, sum(size) as size from sketch group by all)),
parts as (select measure, lang, source, bucket, n * {UNIT} as n, size * {UNIT} as size from sketch union all select g.measure, g.lang, g.source, bucket, {SHARE} from g join l on g.measure = l.measure and g.lang is not distinct from l.lang union all select g.measure, g.lang, g.source, bucket, {SHARE} from g join c on g.measure = c.measure),
run as (select measure, lang, source, bucket, n, size, sum(n) over (partition by measure, lang, source order by bucket) as upto, sum(n) over (partition by measure, lang, source) as total from (select measure, lang, source, bucket, sum(n) as n, sum(size) as size from parts group by all)),
q as (select measure, lang, source, min(bucket) filter (upto * 100 >= total * 25) as q1, min(bucket) filter (upto * 100 >= total * 75) as q3, (coalesce(sum(n) filter (bucket = 0), 0))::double as zeros, (coalesce(sum(n) filter (bucket > 0), 0))::double as others, sum(n)::double as n, sum(size)::double as size from run group by all),
f as (select lang, source, {", ".join(f"max(case when measure = '{m}' then {f'q1 - {FENCE} * (q3 - q1)' if side == 'low' else f'case when q3 > 0 then q3 + {FENCE} * (q3 - q1) else {MODEL}::bigint end'} end)::bigint as {m}_{side}" for m, side in LIMITS)} from q group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({BEYOND}) as kept from m left join f on m.lang is not distinct from f.lang and m.source is not distinct from f.source"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from w, lateral (select unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1), c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)), e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(root) from r where node = d.doc_id) as component_id from documents d left join n using (doc_id)"""

SPLIT = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""with d as (select doc_id, row_number() over () as r, {SPLIT} as w from documents), b as (select item_id, {SPLIT} as w from benchmark),
bw as (select distinct item_id, least(len(w), 13) as span, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as s from b, lateral (select unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i) where len(w) > 0),
spans as (select distinct span from bw), dw as (select r, i, span, array_to_string(w[i:i + span - 1], ' ') as s from d, spans, lateral (select unnest(range(1, len(w) - span + 2)) as i)),
h as (select r, i, span, item_id from dw join bw using (span, s)), c as (select r, count(distinct i + j) as n_hit from h, lateral (select unnest(range(0, span)) as j) group by 1),
t as (select r, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct r, item_id::varchar as x from h) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join c using (r) left join t using (r)"""



def quantised() -> str:
    """Rounds of assignment and averaging as a chain of table expressions: a<k> has the nearest entries by book<k>."""
    out = [f"""with v as (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select r, k as p, x[k * len(x) // {PARTS} + 1:(k + 1) * len(x) // {PARTS}] as x from v, range({PARTS}) t(k)), book0 as (select p, r - 1 as e, x as c from p where r <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        out.append(f"a{k} as (select r, p, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) as best from p join book{k} using (p) group by 1, 2)")
        if k < ROUNDS:
            out.append(f"m{k} as (select p, e, list(floor(s / n) order by i) as c from (select p, best.e as e, i, sum(x[i]) as s, count(*) as n from a{k} join p using (r, p), lateral (select unnest(range(1, len(x) + 1)) as i) group by all) group by 1, 2)")
            out.append(f"book{k + 1} as (select p, e, coalesce(m{k}.c, book{k}.c) as c from book{k} left join m{k} using (p, e))")
    out.append(f"z as (select vec_id, label, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' order by p) as code, sum(best.d)::bigint as error from a{ROUNDS} join v using (r) group by r, vec_id, label)")
    return ", ".join(out) + f" select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint::varchar), ','), ',' order by p, e)) from book{ROUNDS}) as codebooks_sha256 from z"


OP11 = quantised()

OP12 = f"""with u as (select row_number() over () as r, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u), rules(rule_host, rule_path, verdict) as (values {", ".join(map(str, RULES))}),
f as (select r, max_by({{'rule': rule_host || rule_path, 'verdict': verdict}}, length(rule_host || rule_path)) as f from h, rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by 1)
select page_id, host, path, f.rule as rule, coalesce(f.verdict, '{DEFAULT}') as verdict from h left join f using (r)"""

LETTERS = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))
NAMES = [f"l{i}" for i in range(1, len(FILTERS) + 1)]
STEPS = " union all ".join(f"select {' || '.join(f'{x}.f' for x in NAMES)} as filter_order, {k}::int as step, {x}.b as bit, {' + '.join(['0', *(f'{y}.b' for y in NAMES[: k - 1])])} as before from {', '.join(f'letters {y}' for y in NAMES)} where {' | '.join(f'{y}.b' for y in NAMES)} = {2 ** len(FILTERS) - 1}" for k, x in enumerate(NAMES, 1))

OP13 = rf"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {WORDS} as w from documents), l as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels group by 1),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(w) < {FEWEST_WORDS})::int + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::int + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from d left join l using (doc_id)),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all), letters(f, b) as (values {LETTERS}), s as ({STEPS}),
r as (select part, filter_order, step, bit, coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as removed, coalesce(sum(n) filter (mask & before > 0 and mask & bit > 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
coalesce(sum(good) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as toxic_lost from c, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r"""

SQL = {"op1_warc": OP1, "op2_quality_rules": OP2, "op3_jaccard_join": OP3, "op5_decontaminate": OP5, "op11_vector_codes": OP11, "op12_url_filters": OP12, "op13_filter_audit": OP13}
