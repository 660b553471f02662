"""Text functions over whole tables."""

from pyspark.sql import functions as F

from rankspark.functions import fixed, text as tx
from rankspark.functions.dictionary import (
    canonical_label, canonicalize, detect_domain, detect_domains, detect_seniority, expand_skills,
    extract_by_table, extract_skills, find_location, normalize_title,
)
from rankspark.plans.ingest import embedding_text, parse_profiles, search_text
from rankspark.plans.jobs import job_queries
from rankspark.plans.parse import parse_queries as run_parser
from rankspark.plans.search import Engine

from . import common as c

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("tokenize_stats", f"""
with {c.DOC_TOKENS} select id as doc_id, len(toks) as n_tokens,
  list_unique(toks)::bigint as n_distinct, toks[1] as first_token, toks[-1] as last_token,
  md5(array_to_string(toks, ' ')) as all_tokens from dt""")
def tokenize_stats(spark, d):
    docs = c.table(spark, d, "documents").select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return c.flat(docs.select(
        "doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"),
        F.get("t", F.lit(0)).alias("first_token"),
        F.get("t", F.size("t") - 1).alias("last_token"),
        F.md5(F.array_join("t", " ")).alias("all_tokens"),
    ))


@query("query_terms", f"""with {c.BENCH_TERMS.split('qt as')[0].rstrip().rstrip(',')}
select query_id, array_to_string(terms, ',') as terms from qterms""")
def query_terms(spark, d):
    bench = c.table(spark, d, "benchmark")
    return c.flat(bench.select(
        F.col("item_id").alias("query_id"), tx.query_terms(F.col("text")).alias("terms")))


_TERM = ["zzz", "the", "tion"]


@query("snippet", """
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') as words from documents),
l as (select *, list_transform(words, lambda x: trim(lower(x), '.,;:()')) as low from w),
p as (select *, coalesce(
  list_position(list_transform(low, lambda x: contains(x, 'zzz')), true),
  list_position(list_transform(low, lambda x: contains(x, 'the')), true),
  list_position(list_transform(low, lambda x: contains(x, 'tion')), true)) as spot from l)
select doc_id, case when spot is null then array_to_string(words[1:24], ' ')
  else '…' || array_to_string(words[greatest(1, spot - 4):least(len(words), spot + 27)], ' ') || '…' end as snippet
from p""")
def snippet(spark, d):
    docs = c.table(spark, d, "documents")
    return docs.select("doc_id", tx.snippet(F.col("text"), tx.words_array(_TERM)).alias("snippet"))


@query("highlight", """
select doc_id, text as source, len(list_filter(regexp_extract_all(text, '[a-zA-Z0-9]+'),
  lambda x: lower(x) in ('the', 'und', 'der', 'que'))) as n_marked from documents""")
def highlight(spark, d):
    terms = tx.words_array(["the", "und", "der", "que"])
    marked = tx.highlight(F.col("text"), terms)
    return c.flat(c.table(spark, d, "documents").select(
        "doc_id",
        F.regexp_replace(marked, "«((?i:the|und|der|que))»", "$1").alias("source"),
        F.regexp_count(marked, F.lit("«(?i:the|und|der|que)»")).alias("n_marked"),
    ))


@query("content_hash", "select doc_id, sha256(text) as hash from documents")
def content_hash(spark, d):
    return c.table(spark, d, "documents").select(
        "doc_id", tx.content_hash(F.col("text")).alias("hash"))


@query("search_text_build", """
select doc_id, md5(concat_ws(chr(10), nullif('src ' || source, ''), nullif(lang, ''), nullif(array_to_string([lang, source], ' '), ''), nullif(source || ' ' || lang, ''), nullif(text, ''))) as search_text,
  md5(concat_ws(chr(10), nullif('src ' || source, ''), nullif(array_to_string([lang, source], ' '), ''), nullif(text, ''))) as embedding_text
from documents""")
def search_text_build(spark, d):
    skills, empty = F.array("lang", "source"), F.lit("")
    head = F.concat(F.lit("src "), F.col("source"))
    role = F.array(F.concat_ws(" ", "source", "lang"))
    return c.table(spark, d, "documents").select(
        "doc_id",
        F.md5(search_text(head, F.col("lang"), empty, empty, skills, role, F.col("text"))).alias("search_text"),
        F.md5(embedding_text(head, empty, skills, empty, F.col("text"))).alias("embedding_text"),
    )


# --- dictionaries ---------------------------------------------------------------
_ALIASES = [("red widget", "widget", "tool", 0), ("blue bolt", "bolt", "part", 1),
            ("small ring", "ring", "part", 2), ("hot gear", "gear", "part", 3),
            ("red widget", "gear", "part", 4), ("old bolt", "bolt", "part", 5)]


@query("canonicalize", f"""
with a(form, canonical, category, ord) as (values {', '.join(str(r) for r in _ALIASES)}),
o as (select form, arg_min(canonical, ord) as canonical, arg_min(category, ord) as category from a group by form)
select p_partkey, canonical, category from part left join o on lower(p_name) = form""")
def canonicalize_parts(spark, d):
    aliases = spark.createDataFrame(
        _ALIASES, "form string, canonical string, category string, ord int")
    return canonicalize(c.table(spark, d, "part"), "p_name", aliases).select(
        "p_partkey", "canonical", "category")


@query("canonical_fallback", f"""
with a(form, canonical, category, ord) as (values {', '.join(str(r) for r in _ALIASES)}),
o as (select form, arg_min(canonical, ord) as canonical from a group by form)
select coalesce(canonical, lower(p_name)) as label, count(*) as n_parts from part left join o on lower(p_name) = form group by 1""")
def canonical_fallback(spark, d):
    aliases = spark.createDataFrame(
        _ALIASES, "form string, canonical string, category string, ord int")
    linked = canonicalize(c.table(spark, d, "part"), "p_name", aliases)
    label = canonical_label(F.col("canonical"), F.col("p_name")).alias("label")
    return linked.groupBy(label).agg(F.count(F.lit(1)).alias("n_parts"))


_NAMES = ["article", "preposition", "linker", "verb", "pronoun", "r", "n", "unknown"]
_RELATED = ", ".join(
    f"{{'name': '{s.canonical}', 'rel': [{c.quoted_list(s.related)}]::varchar[]}}" for s in c.PROSE.skills)


@query("expand_related", f"""
with base as (select doc_id, [{c.sql_pick(_NAMES, 'doc_id')}, {c.sql_pick(_NAMES, 'doc_id + n_chars')}, {c.sql_pick(_NAMES, 'n_chars')}] as n from documents),
uniq as (select doc_id, list_filter(n, lambda x, i: list_position(n, x) = i) as n from base),
grown as (select doc_id, n, list_reduce(list_transform(n, lambda x: [x]), lambda acc, x:
   case when list_contains(acc, x[1]) then acc else list_concat(acc, list_filter(list_concat([x[1]],
     coalesce(list_filter([{_RELATED}], lambda r: r.name = x[1])[1].rel, []::varchar[])), lambda y: not list_contains(acc, y))) end, []::varchar[]) as g from uniq)
select doc_id, array_to_string(n, ',') as skills, array_to_string(g, ',') as expanded,
  array_to_string(list_filter(g, lambda y: not list_contains(n, y)), ',') as expansions from grown""")
def expand_related(spark, d):
    docs = c.table(spark, d, "documents").selectExpr(
        "doc_id", f"array_distinct(array({c.spark_pick(_NAMES, 'doc_id')}, "
        f"{c.spark_pick(_NAMES, 'doc_id + n_chars')}, {c.spark_pick(_NAMES, 'n_chars')})) as skills")
    grown = docs.withColumn("expanded", expand_skills(F.col("skills"), c.PROSE))
    return c.flat(grown.withColumn("expansions", F.array_except("expanded", "skills")))


@query("dict_extract", f"""
select 'document' as kind, doc_id as id, array_to_string({c.sql_extract('text', c.PROSE, 40)}, ',') as skills from documents
union all
select 'person', id, array_to_string({c.sql_extract('text', c.SAMPLE, 3)}, ',') from (with {c.PEOPLE_TEXT_SQL} select * from people_text)""")
def dict_extract(spark, d):
    def names(frame, key, kind, dictionary, cap):
        found = extract_skills(F.col("text"), dictionary, cap)
        return frame.select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"),
            F.array_join(F.transform(found, lambda m: m["canonical"]), ",").alias("skills"))
    return names(c.table(spark, d, "documents"), "doc_id", "document", c.PROSE, 40).unionByName(
        names(c.people_texts(spark, d), "id", "person", c.SAMPLE, 3))


@query("dict_extract_table", f"""
select 'document' as kind, doc_id as id, array_to_string({c.sql_extract('text', c.PROSE, 40)}, ',') as skills from documents
union all
select 'person', id, array_to_string({c.sql_extract('text', c.SAMPLE, 3)}, ',') from (with {c.PEOPLE_TEXT_SQL} select * from people_text)""")
def dict_extract_table(spark, d):
    """The same mentions with the forms in a table instead of the plan."""
    def names(frame, kind, dictionary, cap):
        found = extract_by_table(frame, dictionary.form_frame(spark), cap)
        return found.select(F.lit(kind).alias("kind"), "id", F.array_join("mentions.canonical", ",").alias("skills"))
    texts = c.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    people = c.people_texts(spark, d).select("id", "text")
    return names(texts, "document", c.PROSE, 40).unionByName(names(people, "person", c.SAMPLE, 3))


_PADDED = "' ' || lower(title) || ' '"
_TITLES_SQL = f"""titles as (select c_custkey as id, {c.sql_pick(c.HEADLINES, 'c_custkey')} as title from customer
  union all select -1 - doc_id, text from documents)"""


@query("title_classify", f"""
with {_TITLES_SQL},
t as (select id, title, {c.sql_first_class(f'({_PADDED})', fixed.SENIORITY_LEVELS)} as seniority,
  coalesce({c.sql_first_class(f'({_PADDED})', fixed.TITLE_FAMILIES)}, ({c.sql_extract('title', c.SAMPLE, 3)})[1] || ' specialist') as family from titles)
select id, seniority, family, case when seniority is not null and family is not null
   and not list_contains(regexp_split_to_array(lower(title), '[ \\t\\n\\r\\f\\v]+'), seniority)
   then seniority || ' ' || family else regexp_replace(title, '^\\s+|\\s+$', '', 'g') end as normalized_title from t""")
def title_classify(spark, d):
    titles = c.table(spark, d, "customer").selectExpr(
        "c_custkey as id", f"{c.spark_pick(c.HEADLINES, 'c_custkey')} as title"
    ).unionByName(c.table(spark, d, "documents").selectExpr(
        "-1 - doc_id as id", "text as title"))
    return titles.select("id", normalize_title(F.col("title"), c.SAMPLE).alias("t")).select(
        "id", "t.seniority", "t.family", "t.normalized_title")


_YEARS_TEXT = f"text || ' ' || {c.sql_pick(c.YEARS_LINES, 'doc_id')}"


@query("parse_years", f"""
with y as (select doc_id, {_YEARS_TEXT} as t from documents)
select doc_id, {c.sql_years('t')} as min_years,
  cast(nullif(regexp_extract(t, '{fixed.YEARS_RANGE_PATTERN}', 1), '') as double) as range_low,
  cast(nullif(regexp_extract(t, '{fixed.YEARS_RANGE_PATTERN}', 2), '') as double) as range_high from y""")
def parse_years(spark, d):
    texts = c.table(spark, d, "documents").selectExpr(
        "doc_id", f"text || ' ' || {c.spark_pick(c.YEARS_LINES, 'doc_id')} as t")
    low, high = tx.parse_years_range(F.col("t"))
    return texts.select("doc_id", tx.parse_years(F.col("t")).alias("min_years"),
                        low.alias("range_low"), high.alias("range_high"))


@query("find_location", c.sql_location(
    "t", "id", f"(with {c.PEOPLE_TEXT_SQL} select id, text as t from people_text union all select -1 - doc_id, text from documents)"))
def find_location_q(spark, d):
    texts = c.people_texts(spark, d).unionByName(
        c.table(spark, d, "documents").selectExpr("-1 - doc_id as id", "text"))
    return texts.select("id", find_location(F.col("text")).alias("p")).select(
        "id", "p.city", "p.country", "p.region")


_DOMAIN_LABELS = ", ".join(
    "case when " + " or ".join(f"contains(low, '{w}')" for w in words) + f" then '{label}' end"
    for label, words in fixed.DOMAINS)


@query("domain_tag", f"""
with s as (select id, lower(text) as low from (with {c.PEOPLE_TEXT_SQL} select id, text from people_text union all select -1 - doc_id, text from documents))
select id, {c.sql_first_class('low', fixed.DOMAINS)} as domain,
  array_to_string(list_filter([{_DOMAIN_LABELS}], lambda x: x is not null)[1:3], ',') as domains from s""")
def domain_tag(spark, d):
    texts = c.people_texts(spark, d).unionByName(
        c.table(spark, d, "documents").selectExpr("-1 - doc_id as id", "text"))
    return c.flat(texts.select("id", detect_domain(F.col("text")).alias("domain"),
                               detect_domains(F.col("text")).alias("domains")))


# --- parsing ----------------------------------------------------------------------
ASKS = [
    "senior python engineer in Berlin with kubernetes", "backend engineers in Dubai",
    "data scientist in Germany, 3-6 years", "technical recruiter for teams in the Gulf",
    "at least 4 years of machine learning", "remote react native developer, 5+ years",
    "product manager with B2B SaaS experience", "someone for payments and compliance",
    "node and postgres fullstack, new york", "",
]
_ASK_SQL = f"""(select conv_id * 1000 + turn as id, text || ' ' || {c.sql_pick(ASKS, 'conv_id + turn')} as raw
  from conversations where role = 'user')"""
_LOW = "lower(raw)"


def _asked(spark, d):
    return c.table(spark, d, "conversations").where("role = 'user'").selectExpr(
        "conv_id * 1000 + turn as query_id",
        f"text || ' ' || {c.spark_pick(ASKS, 'conv_id + turn')} as raw_query")


@query("parse_queries", f"""
with asks as {_ASK_SQL}, loc as ({c.sql_location('raw', 'id', _ASK_SQL)}),
sk as (select id, {c.sql_extract('raw', c.SAMPLE, 8)} as skills from asks)
select asks.id as query_id, array_to_string(skills, ',') as skills,
  coalesce(cast(nullif(regexp_extract(raw, '{fixed.YEARS_RANGE_PATTERN}', 1), '') as double), {c.sql_years('raw')}) as min_years,
  cast(nullif(regexp_extract(raw, '{fixed.YEARS_RANGE_PATTERN}', 2), '') as double) as max_years,
  coalesce({c.sql_first_class("(' ' || lower(raw) || ' ')", fixed.SENIORITY_LEVELS)}, '') as seniority,
  city, country, region, regexp_matches(raw, '{fixed.REMOTE_PATTERN}') as remote,
  {c.sql_first_class(_LOW, fixed.DOMAINS)} as industry, {c.sql_first_class(_LOW, fixed.TITLE_FAMILIES)} as family
from asks join loc using (id) join sk using (id)""")
def parse_queries(spark, d):
    parsed = run_parser(_asked(spark, d), c.SAMPLE)
    names = ("skills", "min_years", "max_years", "seniority", "city", "country", "region",
             "remote", "industry", "family")
    return c.flat(parsed.select("query_id", *[F.col(f"parsed.{n}").alias(n) for n in names]))


@query("parse_free_text")
def parse_free_text(spark, d):
    parsed = run_parser(_asked(spark, d), c.SAMPLE)
    return c.flat(parsed.select("query_id", "parsed.text_terms", "parsed.expansions", "parsed.notes"))


# --- ingestion and jobs ----------------------------------------------------------------
_LINES = r"list_filter(list_transform(regexp_extract_all(t, '[^\r\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_ROLE = " or ".join(f"contains(lower(x), '{w}')" for w in fixed.ROLE_WORDS)
_INGEST_SRC = f"(with {c.PEOPLE_TEXT_SQL} select id, text from people_text union all select -1 - (conv_id * 1000 + turn), text from conversations)"


@query("ingest_profiles", rf"""
with src as (select id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from {_INGEST_SRC}),
loc as ({c.sql_location('text', 'id', _INGEST_SRC)}),
a as (select id, t, {_LINES} as lines, {c.sql_extract('t', c.SAMPLE, 30)} as skills,
  list_transform(regexp_extract_all(t, '{fixed.CALENDAR_YEAR_PATTERN}'), lambda y: y::int) as years_found from src),
b as (select *, left(lines[1], 160) as full_name, left(list_filter(lines[2:6], lambda x: {_ROLE})[1], 220) as headline from a),
e as (select *, ' ' || lower(coalesce(headline, full_name, '')) || ' ' as padded from b)
select e.id, case when len(t) < 30 then 'too short' when len(skills) = 0 then 'no skills' end as reject_reason,
  full_name, headline, {c.sql_first_class('padded', fixed.SENIORITY_LEVELS)} as seniority,
  coalesce({c.sql_years('t')}, case when len(years_found) > 0 then least(greatest(2026 - list_min(years_found), 0), 40)::double end) as years,
  case when loc.city is not null or loc.country is not null or loc.region is not null then coalesce(loc.city, 'Unknown') end as city,
  case when loc.city is not null or loc.country is not null or loc.region is not null then coalesce(loc.country, 'Unknown') end as country,
  loc.region as region, {c.sql_first_class('lower(t)', fixed.DOMAINS)} as industry,
  nullif(regexp_replace(regexp_extract(t, '{fixed.COMPANY_PATTERN}', 1), '^\s+|\s+$', '', 'g'), '') as company,
  nullif(left(regexp_extract(t, '{fixed.DEGREE_PATTERN}'), 160), '') as degree,
  array_to_string(skills, ',') as skills
from e left join loc on e.id = loc.id""")
def ingest_profiles(spark, d):
    texts = c.people_texts(spark, d).unionByName(
        c.table(spark, d, "conversations").selectExpr("-1 - (conv_id * 1000 + turn) as id", "text"))
    parsed = parse_profiles(texts, c.SAMPLE)
    return c.flat(parsed.select(
        "id", "reject_reason", "full_name", "headline", "seniority", "years", "city", "country",
        "region", "industry", "company", "degree",
        F.transform("mentions", lambda m: m["canonical"]).alias("skills")))


JOB_TITLE = "job"
_JOBS_SQL = f"""(select conv_id * 1000 + turn as id, {c.sql_pick(c.SKILL_LINES, 'conv_id')} || ' ' || {c.sql_pick(c.CITY_LINES, 'conv_id')} || ' ' || text as jd
  from conversations where role = 'assistant')"""


def jobs_frame(spark, d):
    return c.table(spark, d, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id * 1000 + turn as job_id",
        f"{c.spark_pick(c.SKILL_LINES, 'conv_id')} || ' ' || {c.spark_pick(c.CITY_LINES, 'conv_id')} || ' ' || text as jd_text")


@query("jd_query_text", rf"""
with jobs as {_JOBS_SQL}, loc as ({c.sql_location('jd', 'id', _JOBS_SQL)}),
p as (select jobs.id, list_concat({c.sql_extract('jd', c.SAMPLE, 12)}, case when city is null then []::varchar[] else [city] end,
  list_transform(list_filter(string_split_regex(replace(left(jd, 500), chr(10), ' '), '[ \t\n\r\f\v]+'), lambda x: len(x) > 6), lambda x: lower(trim(x, '.,;:()')))) as parts
  from jobs join loc using (id))
select id as query_id, left(array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ' '), 400) as raw_query from p""")
def jd_query_text(spark, d):
    return job_queries(jobs_frame(spark, d), Engine(c.SAMPLE)).select("query_id", "raw_query")
