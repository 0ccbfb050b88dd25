"""DuckDB SQL for the rows of this folder's queries, where SQL can express them."""

from __future__ import annotations

from scanloom.llm.pii import IBAN_LENGTHS

EXACT_DEDUP = r"""
with texts as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) as text_sha256,
         regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') as norm
  from documents
)
select doc_id,
       first_value(doc_id) over (partition by norm order by doc_id nulls last) as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over (partition by norm order by doc_id nulls last) = 1 as kept,
       text_sha256
from texts
"""


TOPK = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from vectors q join vectors c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scores)
select * from ranked where rank <= 20
"""


#: By kind: the pattern, the words that raise the score, the score without them, and a condition on a match m.
DIGITS_OF = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS_OF}) + 1), lambda i: case when i % 2 = 1 then substr(reverse({DIGITS_OF}), i, 1)::int else (substr(reverse({DIGITS_OF}), i, 1)::int * 2 // 10 + substr(reverse({DIGITS_OF}), i, 1)::int * 2 % 10) end)) % 10 = 0"
PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "mail|contact|write|address", 70, "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "ip|host|server|address|login", 50, "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(p as int), 0) > 255)) = 0"),
    ("card", r"[0-9]([ -]?[0-9])+", "card|credit|visa|pay|account", 60, f"length({DIGITS_OF}) between 13 and 19 and {LUHN}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "phone|call|tel|mobile|fax|contact", 60, f"length({DIGITS_OF}) between 9 and 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}", "iban|bank|account|transfer|bic", 70, "coalesce(list_reduce(list_prepend(0, list_transform(string_split(substr(replace(part, ' ', ''), 5) || substr(part, 1, 4), ''), lambda c: case when c between '0' and '9' then c::int else ascii(c) - 55 end)), lambda a, x: case when x < 10 then (a * 10 + x) % 97 else (a * 100 + x) % 97 end) = 1, false)"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn|social|security|insurance", 20, "near"),
)
COUNTRIES = "map {" + ", ".join(f"'{country}': {length}" for country, length in IBAN_LENGTHS.items()) + "}"


def personal_data() -> str:
    """One row per match: the pieces of a text between the matches and the matches before give its start."""
    kinds = []
    for place, (kind, pattern, context, score, condition) in enumerate(PERSONAL):
        kinds.append(f"""
select doc_id, {place} as place, '{kind}' as kind, start, start + length({'part' if kind == 'iban' else 'm'}) as stop, {score} + case when near then 30 else 0 end as score from (
  select *, regexp_matches(lower(substr(text, greatest(start - 40, 0) + 1, least(start, 40))), '{context}') as near,
         list_filter(list_transform(range(1, length(m) + 1), lambda i: substr(m, 1, i)), lambda p: length(replace(p, ' ', '')) = {COUNTRIES}[substr(m, 1, 2)] and not p like '% ')[1] as part
  from (
    select doc_id, text, ms[i] as m, (list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as start
    from (select doc_id, text, ms, gs, unnest(range(1, len(ms) + 1)) as i from (select doc_id, text, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as gs from texts))
  )
) where {condition}""")
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
spans as ({' union all '.join(kinds)}),
said as (
  select doc_id, count(*) filter (where kind = 'email') as e, count(*) filter (where kind = 'ip') as i, count(*) filter (where kind = 'card') as c, count(*) filter (where kind = 'phone') as p,
         string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by place, start) filter (where place < 4) as base,
         string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by place, start) as every,
         string_agg(score::varchar, ',' order by place, start) as scores
  from spans group by doc_id
)
select t.doc_id, coalesce(e, 0) as n_email, coalesce(i, 0) as n_ip, coalesce(c, 0) as n_card, coalesce(p, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans, coalesce(scores, '') as scores
from texts t left join said using (doc_id)
"""


def either_case(words: str) -> str:
    """A pattern in which each letter, but not those behind a backslash, stands for both of its cases."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: By kind: the pattern, and a condition on a match m.
ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')})[\"'']? *[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)"
SECRETS = (
    ("assign", ASSIGN, f"length(regexp_extract(m, '{ASSIGN}', 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("github", "gh[oprsu]_[A-Za-z0-9]{36,}", "true"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", "true"),
    ("google", "AIza[A-Za-z0-9_-]{35}", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("key_block", "-----BEGIN ([A-Z]+ )?PRIVATE KEY-----", "true"),
)


def secret_spans() -> str:
    kinds = [
        f"""
select doc_id, {place} as place, '{kind}' as kind, start, start + length(m) as stop from (
  select doc_id, ms[i] as m, (list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as start
  from (select doc_id, ms, gs, unnest(range(1, len(ms) + 1)) as i from (select doc_id, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as gs from texts))
) where {condition}"""
        for place, (kind, pattern, condition) in enumerate(SECRETS)
    ]
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
spans as ({' union all '.join(kinds)}),
said as (
  select doc_id, count(*) filter (where place = 0) as a, count(*) filter (where place = 1) as k, count(*) filter (where place = 2) as h,
         string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, place) filter (where place < 3) as base,
         string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, place) as every
  from spans group by doc_id
)
select t.doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans
from texts t left join said using (doc_id)
"""


#: Sources by weight, filled up to their caps: a source is capped once an equal share per weight exceeds its cap.
TARGETS = r"""
with recursive sized as (select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> ''))::bigint as size from documents),
sources as (select source, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from sized group by 1),
levels(step, level, before) as (
  select 0, (select sum(source_size) / sum(weight) from sources)::double, -1::double
  union all
  select step + 1, (select (sum(source_size) - coalesce(sum(3 * source_size) filter (where 3 * source_size / weight < level), 0)) / coalesce(nullif(sum(weight) - coalesce(sum(weight) filter (where 3 * source_size / weight < level), 0), 0), 1) from sources), level
  from levels where level <> before
),
last as (select max(level) as level from levels)
select d.doc_id, d.size, s.source_size, round(case when 3 * s.source_size / s.weight < level then 3 * s.source_size else s.weight * level end, 4)::double as target
from sized d join sources s on s.source is not distinct from d.source, last
"""


SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All windows of items against all runs of as many words of documents.
DECONTAMINATION = rf"""
with words as (select row_number() over () as r, doc_id, regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select coalesce(item_id::varchar, '') as item, regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item, least(len(w), 10) as l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as t
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)
),
places as (select r, i, l, array_to_string(w[i:i + l - 1], ' ') as t from (select r, w, l, unnest(range(1, len(w) - l + 2)) as i from words, (select distinct l from windows) where len(w) >= l)),
found as (select r, i, l, item from places join windows using (l, t)),
hits as (select r, count(*) as n from (select distinct r, unnest(range(i, i + l)) as p from found) group by r),
named as (select r, count(*) as n, string_agg(item, ',' order by item) as names from (select distinct r, item from found) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(m.n, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from words left join hits h using (r) left join named m using (r)
"""


#: All kept terms in all pairs of a language's sources.
DIVERGENCE = rf"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({SMALL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
tokens as (select r, lang, source, unnest(w) as term from docs),
kept as (select lang, term, count(*)::hugeint as n from tokens group by 1, 2 having count(distinct r) >= 3),
sizes as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by 1),
groups as (select lang, source from docs group by 1, 2),
counts as (select lang, source, term, count(*)::hugeint as n from tokens semi join kept using (lang, term) group by 1, 2, 3),
totals as (select lang, source, coalesce(sum(n), 0)::hugeint as total from groups left join counts using (lang, source) group by 1, 2),
shares as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (total + v) as p, 1 + 1000000000 * (k.n + 1) // (z.n + v) as q
  from totals t join kept k on t.lang = k.lang join sizes z on z.lang = t.lang left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term
),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from shares where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from (select * from pairs union all select * from terms) qualify part = 'pair' or rank <= 200
"""


HARD_NEGATIVES = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double))::double[] as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score from vectors a join vectors c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scores where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": TOPK, "op8_secrets": secret_spans(), "op9_exact_dedup": EXACT_DEDUP, "op10_pii": personal_data(), "op11_decontamination": DECONTAMINATION, "op12_divergence": DIVERGENCE, "op13_hard_negatives": HARD_NEGATIVES, "mixing_targets": TARGETS}
