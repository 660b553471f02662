"""SQL that says the same as the newer operators in another way, for DuckDB."""

from __future__ import annotations

from rankspark.llm import personal_data as p

_MATCHED = {  # plain patterns, greedy and without looking around
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[^A-Za-z0-9][A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "ssn": "[0-9-]+",
}


def _found(kind: str) -> str:
    text = "' ' || text" if kind == "iban" else "text"  # one character before the number belongs to the match
    return (f"select r, doc_id, text, '{kind}' as kind, {p.KINDS.index(kind)} as place, regexp_extract_all({text}, '{_MATCHED[kind]}') as m, "
            f"string_split_regex({text}, '{_MATCHED[kind]}') as g from t")


def _by_kind(values: dict) -> str:
    return "case kind " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


def _near(words: str) -> str:
    return f"case when regexp_matches(near, '(?:^|[^a-z])(?:{words})(?:[^a-z]|$)') then 1 else 0 end"


_DIGITS = "regexp_replace(match, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda i:
  case when i % 2 = 1 then cast(reverse({_DIGITS})[i] as int)
       else cast(reverse({_DIGITS})[i] as int) * 2 - case when reverse({_DIGITS})[i] > '4' then 9 else 0 end end)) % 10 = 0"""
_BY_97 = """list_reduce(list_prepend(0, list_transform(string_split(head[5:] || head[:4], ''),
  lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)), lambda a, v: (a * (case when v < 10 then 10 else 100 end) + v) % 97)"""

PERSONAL = rf"""
with t as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
found as ({' union all '.join(map(_found, p.KINDS))}),
each as (
  select r, doc_id, text, kind, place, m[i] as raw,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start
  from (select *, unnest(generate_series(1, len(m))) as i from found)),
matches as (
  select r, doc_id, text, kind, place, cast(start as bigint) as start, case when kind = 'iban' then raw[2:] else raw end as match from each
  where case kind when 'ssn' then regexp_full_match(raw, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')
    when 'card' then length(regexp_replace(raw, '[^0-9]', '', 'g')) between 14 and 19 else true end),
sides as (
  select *, start + length(match) as stop, coalesce(lag(start + length(match)) over w, 0) as prior, coalesce(lead(start) over w, length(text)) as later
  from matches window w as (partition by r, kind order by start)),
around as (
  select *, lower(text[greatest(prior, start - {p.BEFORE}) + 1:start] || ' ' || text[stop + 1:least(later, stop + {p.AFTER})]) as near,
    text[stop + 1:least(later, stop + 1)] as follows,
    map {{{', '.join(f"'{k}': {v}" for k, v in p.IBAN_LENGTHS.items())}}}[match[:2]] as size from sides),
cut as (
  select *, replace(match, ' ', '')[:size] as head, size + case when match[5] = ' ' then (size - 1) // 4 else 0 end as wide,
    length(replace(match, ' ', '')) as compact from around),
judged as (
  select *, {_by_kind({
    'email': 'length(match)',
    'ip': r"case when length(list_filter(string_split(match, '.'), lambda x: length(ltrim(x, '0')) > 3 or cast('0' || ltrim(x, '0')[:3] as int) > 255)) = 0 then length(match) end",
    'card': f"case when {_LUHN} then length(match) end",
    'phone': f"case when length({_DIGITS}) between 10 and 15 then length(match) end",
    'iban': f"case when compact >= size and not regexp_matches(case when wide < length(match) then match[wide + 1] else follows end, '[A-Za-z0-9]') and {_BY_97} = 1 then wide end",
    'ssn': f"case when not regexp_matches(match, '{p.SSN_UNUSED}') then length(match) end"})} as width,
    least(100, {_by_kind(p.SCORES)} + {p.BONUS} * ({_by_kind({k: _near(w) for k, w in p.NEARBY.items()})}) - {p.MALUS} * ({_near(p.AGAINST)})) as score
  from cut),
kept as (
  select r, kind, place, start, score, kind || ':' || start || ':' || (start + width) as span from judged
  where width is not null and (place < {len(p.BASE)} or score >= {p.KEEP})),
listed as (
  select r, {', '.join(f"count(*) filter (kind = '{k}') as n_{k}" for k in p.BASE)},
    coalesce(string_agg(span, ',' order by start, place) filter (place < {len(p.BASE)}), '') as base,
    string_agg(span, ',' order by start, place) as spans, string_agg(cast(score as varchar), ',' order by start, place) as scores
  from kept group by r)
select doc_id, {', '.join(f"coalesce(n_{k}, 0) as n_{k}" for k in p.BASE)}, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(scores, '') as scores
from t left join listed using (r)"""


def _clusters() -> str:
    """The rounds written out one after the other."""
    from rankspark.llm.centroids import CLUSTERS, COMPONENTS, ROUNDS, SCALE, SEED

    parts = [f"""
v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as e from embeddings
  where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, e) - 1 as k, e from v
  qualify row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, e) <= {CLUSTERS})"""]
    for n in range(ROUNDS + 1):
        parts.append(f"""
a{n} as materialized (
  select r, vec_id, v.e, unnest(min_by(struct_pack(k := k, d := d), [d, k])) from (
    select r, vec_id, v.e, k, list_sum(list_transform(list_zip(v.e, c{n}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
    from v, c{n}) v group by r, vec_id, v.e)""")
        if n < ROUNDS:
            parts.append(f"""
s{n} as (select k, i, sum(e[i])::bigint as s, count(*) as n from (select k, e, unnest(generate_series(1, {COMPONENTS})) as i from a{n}) group by k, i),
m{n} as (select k, list((s - (((s % n) + n) % n)) // n order by i) as e from s{n} group by k),
c{n + 1} as materialized (select c{n}.k, coalesce(m{n}.e, c{n}.e) as e from c{n} left join m{n} using (k))""")
    return "with " + ",".join(parts) + f"""
select a.vec_id, cast(a.k as int) as cluster, a.d as distance, cast(sum(a.d) over (partition by a.k) as bigint) as cluster_inertia,
  cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.e, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c using (k)"""


CLUSTERS = _clusters()


#: crc32 of a text's bytes, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

TRIE = f"""
with turns as materialized (
  select conv_id, name, points, row_number() over (partition by conv_id order by turn nulls first, name) - 1 as pos from (
    select conv_id, turn, length(coalesce(text, '')) as points,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as name from conversations where conv_id is not null)),
convs as (select distinct conv_id, {_CRC} % 6 as h from turns),
kept as (
  select c.conv_id, 0 as part, t.pos, t.name, t.points from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 100 and t.pos < c.h
  union all select conv_id, 1, pos, name, points from turns join convs using (conv_id) where pos >= h),
seqs as materialized (
  select conv_id, coalesce(list(name order by part, pos) filter (name is not null), []) as names,
    coalesce(list(points order by part, pos) filter (name is not null), []) as points from convs left join kept using (conv_id) group by conv_id),
paths as (select conv_id, names[:d] as key, d, len(names) = d as ends, points[d] as last from (select *, unnest(generate_series(0, len(names))) as d from seqs)),
nodes as materialized (
  select key, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(case when d > 0 then last else 0 end) * (count(*) - 1) as own,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from paths group by key),
children as materialized (select key[:depth - 1] as key, count(*) as n from nodes where depth > 0 group by 1),
below as (
  select key[:a] as key, sum(own) as saved, count(*) filter (childless) as leaves from (
    select n.key, n.own, c.n is null as childless, unnest(generate_series(0, n.depth)) as a from nodes n left join children c using (key)) group by 1)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, b.leaves as n_leaves,
  cast(b.saved as bigint) as saved_tokens, n.ends_sha256
from nodes n join below b using (key) left join children c using (key) left join nodes p on n.depth > 0 and p.key = n.key[:n.depth - 1]"""
