"""Evaluation, evidence, and whole searches."""

from pyspark.sql import functions as F

from rankspark.functions import fixed, text as tx
from rankspark.functions.dictionary import extract_skills
from rankspark.operators import embedding, evidence, lexical, metrics, vector
from rankspark.operators.shape import lookup_join, rows_at_most
from rankspark.plans import ingest, jobs
from rankspark.plans.parse import parse_jobs
from rankspark.plans.saved import SavedSearches
from rankspark.plans.search import Engine, as_profiles, pool_vectors, rank_strategies, search
from rankspark.plans.segments import SegmentedIndex
from rankspark.session import scratch_dir, written

from . import common as c
from .profiles import asked
from .retrieval import sql_embedding, vectors
from .texts import _JOBS_SQL, ASKS, jobs_frame

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


ENGINE = Engine(c.SAMPLE, embedding.hash_embedder(c.SAMPLE, digest="md5"))


# --- evaluation ---------------------------------------------------------------------------
def _rules():
    has = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), "skills")) == 0
    years = F.coalesce("years", F.lit(0.0))
    head = F.lower(F.coalesce("headline", F.lit("")))
    return [
        ("backend", F.contains(head, F.lit("backend")) & (years >= 15), F.contains(head, F.lit("backend"))),
        ("brands", has("brand#1", "brand#2"), has("brand#1") | has("brand#2")),
        ("asia", (F.col("region") == "ASIA") & (F.col("industry") == "BUILDING"), F.col("region") == "ASIA"),
        ("staff", F.coalesce("seniority", F.lit("")).isin("staff", "lead") & (years >= 5), F.col("seniority") == "senior"),
        ("none", F.lit(False), F.col("city") == "NOWHERE"),
    ]


@query("golden_grades", f"""with {c.PEOPLE_SKILLS_SQL}, f as (select *, coalesce(years, 0) as y, lower(coalesce(headline, '')) as head from people_skills),
g as (select 'backend' as query_id, id, case when contains(head, 'backend') and y >= 15 then 2 when contains(head, 'backend') then 1 else 0 end as grade from f union all
 select 'brands', id, case when list_has_all(skills, ['brand#1', 'brand#2']) then 2 when list_has_any(skills, ['brand#1', 'brand#2']) then 1 else 0 end from f union all
 select 'asia', id, case when region = 'ASIA' and industry = 'BUILDING' then 2 when region = 'ASIA' then 1 else 0 end from f union all
 select 'staff', id, case when coalesce(seniority, '') in ('staff', 'lead') and y >= 5 then 2 when seniority = 'senior' then 1 else 0 end from f union all
 select 'none', id, case when city = 'NOWHERE' then 1 else 0 end from f)
select query_id, id, grade::bigint as grade from g where grade > 0""")
def golden_grades(spark, d):
    return c.flat(metrics.grade_by_rules(c.people_with_skills(spark, d), _rules()))


def _two_strategies(spark, d):
    """Per class two queries: its mean vector, and its first member."""
    pool = vectors(spark, d)
    cells = pool.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # at most one value per dimension in a class's list
    mean = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("x"))
    mean = mean.select(F.col("label").alias("query_id"), F.col("x.v").alias("embedding"))
    first = pool.groupBy("label").agg(F.min_by("embedding", "id").alias("embedding"))
    first = first.select(F.col("label").alias("query_id"),
                         F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    by_mean = vector.vector_topk(mean, pool).withColumn("strategy", F.lit("mean"))
    by_first = vector.vector_topk(first, pool).withColumn("strategy", F.lit("first"))
    grades = pool.select(F.col("label").cast("bigint").alias("query_id"), "id",
                         F.when(F.col("id") % 2 == 0, 2).otherwise(1).alias("grade"))
    return by_mean.unionByName(by_first), grades


_METRICS_SQL = """with v as (select vec_id as id, label, embedding::double[] as e from embeddings),
m as (select label, list(v order by pos) as e from (select label, pos, avg(x) as v from (select label, unnest(e) as x, generate_subscripts(e, 1) as pos from v) group by label, pos) group by label),
q as (select 'mean' as strategy, label as query_id, e from m union all select 'first', label, arg_min(e, id) from v group by label),
s as (select strategy, query_id, v.id, v.label, round(list_cosine_similarity(q.e, v.e), 6) as score from q cross join v),
r as (select *, row_number() over (partition by strategy, query_id order by score desc, id) as rank,
   case when label = query_id then case when id % 2 = 0 then 2 else 1 end else 0 end as grade from s),
top as (select * from r where rank <= 50),
ideal as (select label as query_id, row_number() over (partition by label order by case when id % 2 = 0 then 2 else 1 end desc) as pos, case when id % 2 = 0 then 2 else 1 end as grade from v),
idcg as (select query_id, sum(case when pos <= 10 then (pow(2, grade) - 1) / log2(pos + 1) else 0 end) as ideal, count(*) as total_relevant from ideal group by query_id),
per as (select strategy, query_id::bigint as query_id,
  round(count(*) filter (rank <= 10 and grade > 0) / 10.0, 4)::double as precision_at_k,
  round(count(*) filter (rank <= 10 and grade > 0) / any_value(total_relevant), 4)::double as recall_at_k,
  round(coalesce(1.0 / min(rank) filter (grade > 0), 0), 4)::double as mrr,
  round(coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) filter (rank <= 10), 0) / any_value(ideal), 4)::double as ndcg_at_k,
  any_value(total_relevant)::bigint as total_relevant
  from top join idcg using (query_id) group by strategy, query_id)"""


@query("metrics_per_query", _METRICS_SQL + " select * from per")
def metrics_per_query(spark, d):
    ranking, grades = _two_strategies(spark, d)
    return c.flat(metrics.evaluate_rankings(ranking, grades, 10))


@query("strategy_comparison", _METRICS_SQL + """,
a as (select strategy, round(avg(precision_at_k), 4) as precision_at_k, round(avg(recall_at_k), 4) as recall_at_k, round(avg(mrr), 4) as mrr, round(avg(ndcg_at_k), 4) as ndcg_at_k from per group by strategy),
l as (unpivot a on precision_at_k, recall_at_k, mrr, ndcg_at_k into name metric value value)
select strategy, metric, value, value = max(value) over (partition by metric) as is_best from l""")
def strategy_comparison(spark, d):
    ranking, grades = _two_strategies(spark, d)
    return metrics.compare_strategies(metrics.evaluate_rankings(ranking, grades, 10))


@query("top_results", _METRICS_SQL + """
select strategy, query_id::bigint as query_id, string_agg(id::varchar, ',' order by rank) as top_ids, string_agg(grade::varchar, ',' order by rank) as top_grades from top where rank <= 10 group by 1, 2""")
def top_results(spark, d):
    ranking, grades = _two_strategies(spark, d)
    return c.flat(metrics.top_results(ranking, grades, 10))


# --- documents as profiles ------------------------------------------------------------------
def document_profiles(spark, d):
    docs = c.table(spark, d, "documents")
    return as_profiles(docs, id=F.col("doc_id"), industry=F.col("lang"))


def bench_queries(spark, d):
    return c.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("raw_query"))


_SAMPLE_RELATED = ", ".join(
    f"{{'name': '{s.canonical}', 'rel': [{c.quoted_list(s.related)}]::varchar[]}}" for s in c.SAMPLE.skills)

_HYBRID_SQL = f"""
with named as (select item_id as query_id, text as raw, {c.sql_first_class('lower(text)', fixed.TITLE_FAMILIES)} as family,
  {c.sql_extract('text', c.SAMPLE, 8)} as found from benchmark),
qraw as (select query_id, raw, family, found, array_to_string(list_filter(flatten(list_transform(found, lambda n:
  list_filter([{_SAMPLE_RELATED}], lambda r: r.name = n)[1].rel)), lambda y: not list_contains(found, y)), ' ') as expansions from named),
free as ({c.sql_terms('raw', 'query_id', 'qraw', stop=c.FILLER)}),
qterms as (select query_id, list_filter(terms, lambda x: not list_contains({c.STOP}, x)) as terms from free),
qt as (select query_id, unnest(terms) as term, generate_subscripts(terms, 1) as pos from qterms),
{c.DOC_TOKENS}, {c.BM25.split(c.DOC_TOKENS + ',')[1]},
vd as (select id, toks from dt), vq as (select query_id as id, {c.sql_tokens("raw || ' ' || expansions")} as toks from qraw),
{sql_embedding('vd', name='de')}, {sql_embedding('vq', name='qe')},
sims as (select q.id as query_id, p.id, round(sum(q.value * p.value), 6) as score from qe q join de p using (bucket) group by q.id, p.id),
allsims as (select query_id, vd.id, coalesce(score, 0) as score from qraw cross join vd left join sims using (query_id, id)),
vec as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from allsims) where rank <= 50),
hits as (select query_id, id, rank, score, 'lexical' as retriever from bm25 union all select query_id, id, rank, score, 'vector' from vec),
fused as (select query_id, id, round(sum(1.0::double / (60 + rank)), 8) as fused, max(case when retriever = 'lexical' then rank end) as lexical_rank,
  max(case when retriever = 'vector' then rank end) as vector_rank from hits group by query_id, id),
norm as (select *, count(*) over w as total, row_number() over (partition by query_id order by fused desc, id) as fused_rank,
  case when max(fused) over w = min(fused) over w then 1.0 else (fused - min(fused) over w) / (max(fused) over w - min(fused) over w) end as normalized
  from fused window w as (partition by query_id)),
reranked as (select norm.*, round(0.55 * round(normalized, 4) + 0.17 * case when family is null then 0.5 else 0 end + 0.15 * case when len(found) > 0 then 0 else 0.5 end + 0.13 * 0.5, 6) as score
  from norm join qraw using (query_id) where fused_rank <= 60)"""


@query("hybrid_search", _HYBRID_SQL + """
select query_id, id, rank, score, fused, lexical_rank, vector_rank, total from (
  select *, row_number() over (partition by query_id order by score desc, id) as rank from reranked) where rank <= 20""")
def hybrid_search(spark, d):
    """The flagship: all benchmark passages searched in all documents."""
    results = search(bench_queries(spark, d), document_profiles(spark, d), ENGINE)
    return c.flat(results.select(
        "query_id", "id", "rank", "score", F.col("components.fusion.score").alias("fused"),
        F.col("components.lexical.rank").alias("lexical_rank"),
        F.col("components.vector.rank").alias("vector_rank"), "total"))


@query("hybrid_search_indexed", _HYBRID_SQL + """
select query_id, id, rank, score, fused, lexical_rank, vector_rank, total from (
  select *, row_number() over (partition by query_id order by score desc, id) as rank from reranked) where rank <= 20""")
def hybrid_search_indexed(spark, d):
    """The same search from a stored index and stored vectors: it tokenises and embeds queries alone."""
    profiles = document_profiles(spark, d)
    index = SegmentedIndex(spark, scratch_dir(spark), buckets=8)
    index.add(profiles.select("id", "text"))
    stored = written(pool_vectors(profiles, ENGINE).select("id", "embedding"))
    results = search(bench_queries(spark, d), profiles, ENGINE, vectors=stored, index=index)
    return c.flat(results.select(
        "query_id", "id", "rank", "score", F.col("components.fusion.score").alias("fused"),
        F.col("components.lexical.rank").alias("lexical_rank"),
        F.col("components.vector.rank").alias("vector_rank"), "total"))


@query("saved_rerun", f"""
with {c.DOC_TOKENS}, vd as (select id, toks from dt), vq as (select item_id as id, {c.sql_tokens('text')} as toks from benchmark),
{sql_embedding('vd', name='de')}, {sql_embedding('vq', name='qe')},
sims as (select q.id as saved_id, p.id, round(sum(q.value * p.value), 6) as score from qe q join de p using (bucket) group by q.id, p.id),
allsims as (select item_id as saved_id, vd.id, coalesce(score, 0) as score from benchmark cross join vd left join sims on saved_id = item_id and sims.id = vd.id)
select saved_id, rank, id, score from (select *, row_number() over (partition by saved_id order by score desc, id) as rank from allsims) where rank <= 50""")
def saved_rerun(spark, d):
    """Passages saved as searches: run over two thirds of the documents, then again when the rest has come
    and some have left; the second run searches what is new and equals a full one."""
    engine = Engine(c.SAMPLE, embedding.hash_embedder(c.SAMPLE, digest="md5", value_type="double"))
    own = SavedSearches(spark, scratch_dir(spark), engine, partitions=8)
    own.create(c.table(spark, d, "benchmark").select(
        F.col("item_id").alias("saved_id"), F.lit("passage").alias("name"), F.col("text").alias("raw")))
    profiles = document_profiles(spark, d)
    stored = pool_vectors(profiles, engine).select("id", "embedding", F.when(F.col("id") % 3 < 2, 1).otherwise(2).cast("bigint").alias("version"))
    pool = written(stored)
    passing = pool.where("id % 97 = 0").withColumn("id", -F.col("id") - 1).withColumn("version", F.lit(1).cast("bigint"))
    own.rerun(pool.where("version = 1").unionByName(passing))
    return c.flat(own.rerun(pool))


_GRADES_SQL = r"""
lines as (select distinct item_id as query_id, unnest(regexp_extract_all(text, '[^.\n]{12,}')) as line from benchmark),
dlines as (select distinct doc_id as id, unnest(regexp_extract_all(text, '[^.\n]{12,}')) as line from documents),
grades as (select query_id, id, case when count(*) > 1 then 2 else 1 end as grade from lines join dlines using (line) group by 1, 2)"""


def passage_grades(spark, d):
    """A document with one sentence of a benchmark passage is acceptable, with more ideal."""
    def sentences(name, key, out):
        frame = c.table(spark, d, name)
        return frame.select(
            F.col(key).alias(out), F.explode(tx.find_all(F.col("text"), r"[^.\n]{12,}")).alias("line"))
    # Few sentences of passages travel to those of the documents, of which only the ones met are shuffled.
    wanted = sentences("benchmark", "item_id", "query_id").distinct()
    met = lookup_join(sentences("documents", "doc_id", "id"), wanted, ["line"], rows_at_most(wanted))
    return met.distinct().groupBy("query_id", "id").agg(
        F.when(F.count(F.lit(1)) > 1, 2).otherwise(1).alias("grade"))


@query("passage_grades", f"with {_GRADES_SQL} select query_id, id, grade::bigint as grade from grades")
def passage_grades_q(spark, d):
    return c.flat(passage_grades(spark, d))


@query("benchmark_strategies", _HYBRID_SQL + f""", {_GRADES_SQL},
deep as (select norm.*, round(0.55 * round(normalized, 4) + 0.17 * case when family is null then 0.5 else 0 end + 0.15 * case when len(found) > 0 then 0 else 0.5 end + 0.13 * 0.5, 6) as score
  from norm join qraw using (query_id) where fused_rank <= 150),
ranked as (select 'lexical' as strategy, query_id, id, rank from bm25 union all select 'vector', query_id, id, rank from vec union all
  select 'hybrid', query_id, id, fused_rank from norm where fused_rank <= 50 union all
  select 'hybrid_rerank', query_id, id, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from deep) where rank <= 50),
ideal as (select *, row_number() over (partition by query_id order by grade desc) as pos from grades),
idcg as (select query_id, sum(case when pos <= 10 then (pow(2, grade) - 1) / log2(pos + 1) else 0 end) as ideal, count(*) as total from ideal group by 1),
per as (select strategy, query_id, round(count(grade) filter (rank <= 10) / 10.0, 4) as p,
   round(coalesce(count(grade) filter (rank <= 10) / any_value(total), 0), 4) as r, round(coalesce(1.0 / min(rank) filter (grade > 0), 0), 4) as m,
   round(coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) filter (rank <= 10) / any_value(ideal), 0), 4) as n
   from ranked left join grades using (query_id, id) left join idcg using (query_id) group by 1, 2),
every as (select strategy, item_id as query_id from benchmark cross join (values ('lexical'), ('vector'), ('hybrid'), ('hybrid_rerank')) s(strategy)),
a as (select strategy, round(avg(coalesce(p, 0)), 4) as precision_at_k, round(avg(coalesce(r, 0)), 4) as recall_at_k, round(avg(coalesce(m, 0)), 4) as mrr,
   round(avg(coalesce(n, 0)), 4) as ndcg_at_k from every left join per using (strategy, query_id) group by 1),
l as (unpivot a on precision_at_k, recall_at_k, mrr, ndcg_at_k into name metric value value)
select strategy, metric, value::double as value, value = max(value) over (partition by metric) as is_best from l""")
def benchmark_strategies(spark, d):
    """Four strategies on the benchmark passages, retrieval run once."""
    queries = bench_queries(spark, d)
    ranking = rank_strategies(queries, document_profiles(spark, d), ENGINE)
    per_query = metrics.evaluate_rankings(
        ranking, passage_grades(spark, d), 10, queries,
        ("lexical", "vector", "hybrid", "hybrid_rerank"))
    return metrics.compare_strategies(per_query)


# --- evidence ---------------------------------------------------------------------------------
_WANTED = ["article", "verb", "r", "linker"]
_OTHERS = ["preposition", "linker", "n"]


@query("why_evidence", f"""
with m as (select doc_id, lang, source, n_chars, {c.sql_extract('text', c.PROSE, 40)} as found,
  [{c.sql_pick(_WANTED, 'doc_id')}, 'pronoun'] as wanted, [{c.sql_pick(_OTHERS, 'doc_id')}, 'pronoun'] as others from documents)
select doc_id, array_to_string(list_filter(found, lambda x: list_contains(wanted, x)), ',') as matched,
  array_to_string(list_filter(found, lambda x: list_contains(others, x) and not list_contains(wanted, x)), ',') as related,
  concat_ws('; ', case when n_chars / 100 >= 10 then 'experience ' || (n_chars // 100) || ' yrs ≥ 10 requested' end,
    case when lang = 'en' then 'based in en, as requested' end, case when source = 'src2' then 'src2 level matches the request' end) as signals from m""")
def why_evidence(spark, d):
    docs = c.table(spark, d, "documents")
    found = F.transform(
        extract_skills(F.col("text"), c.PROSE),
        lambda m: F.struct(m["canonical"].alias("canonical"), m["matched_alias"].alias("raw"),
                           m["evidence"].alias("evidence")))
    rows = docs.select(
        "doc_id", found.alias("mentions"), F.floor(F.col("n_chars") / 100).cast("double").alias("years"),
        F.lit(None).cast("string").alias("city"), F.col("lang").alias("country"),
        F.lit(None).cast("string").alias("region"), F.col("source").alias("seniority"),
        F.lit(None).cast("string").alias("industry"),
        F.expr(f"""named_struct('skills', array({c.spark_pick(_WANTED, 'doc_id')}, 'pronoun'),
          'expansions', array({c.spark_pick(_OTHERS, 'doc_id')}, 'pronoun'), 'min_years', 10.0D, 'max_years', cast(null as double),
          'seniority', array('src2'), 'city', cast(null as string), 'country', 'en', 'region', cast(null as string),
          'industry', cast(null as string), 'family', cast(null as string))""").alias("parsed"),
        F.expr("named_struct('skills', cast(null as array<string>))").alias("filters"))
    none = F.array().cast("array<string>")
    why = rows.select("doc_id", evidence.why(
        F.col("parsed"), F.col("filters"), none, F.lit(""), none).alias("why"))
    names = lambda col: F.array_join(F.col(f"{col}.skill"), ",")
    return why.select("doc_id", names("why.matched_skills").alias("matched"),
                      names("why.related_skills").alias("related"),
                      F.array_join("why.signals_matched", "; ").alias("signals"))


# --- people: parsed texts as profiles -----------------------------------------------------------
def people_profiles(spark, d):
    """Parsed once and written: a search uses the pool several times."""
    columns = ["id", "text", "headline", "seniority", "years", "city", "country", "region", "industry",
               "mentions", "embedding_text"]
    parsed = ingest.parse_profiles(c.people_texts(spark, d), c.SAMPLE)
    # Written before rejects are dropped: the engine moves a filter below the spreading over the cores, and the
    # one task that reads the file would parse all texts for it.
    return ingest.accepted(written(parsed.select("reject_reason", *columns))).select(columns)


@query("search_people")
def search_people(spark, d):
    """Free-text asks with hard filters, over every customer's derived text."""
    texts = [a for a in ASKS if a] * 2
    filter_list = [{} for _ in texts[: len(texts) // 2]] + [
        {"min_years": 5.0}, {"seniority": ["senior"]}, {"countries": ["Germany"]},
        {"region": "MENA"}, {"skills": ["machine-learning"]}, {"skills": ["react-native"]},
        {"industry": "SaaS"}, {"max_years": 6.0, "family": "data scientist"}, {"industry": "None"}]
    frame = asked(spark, filters=filter_list)
    queries = frame.join(spark.createDataFrame(
        list(enumerate(texts)), "query_id bigint, raw_query string"), "query_id")
    results = search(queries, people_profiles(spark, d), ENGINE)
    return c.flat(results.select(
        "query_id", "rank", "id", "score", "total", "headline", "location", "skills",
        F.array_join("why.rerank_notes", "; ").alias("notes"),
        F.array_join("why.signals_matched", "; ").alias("signals"),
        F.array_join("why.matched_skills.skill", ",").alias("matched"),
        F.col("why.snippet").alias("snippet")))


@query("jd_match")
def jd_match(spark, d):
    results = jobs.match_jobs(jobs_frame(spark, d), people_profiles(spark, d), ENGINE)
    return c.flat(results.select("query_id", "rank", "id", "score", "total"))


@query("jd_gaps", f"""
with jobs as {_JOBS_SQL}, {c.PEOPLE_TEXT_SQL},
asked as (select id as query_id, {c.sql_extract('jd', c.SAMPLE, 12)} as skills from jobs),
qterms as ({c.sql_terms('jd', 'id', 'jobs')}),
qt as (select query_id, unnest(terms) as term, generate_subscripts(terms, 1) as pos from qterms),
dt as (select id, {c.sql_tokens('text')} as toks from people_text), {c.TERM_COUNTS}, {c.OR_RANK},
own as (select id, {c.sql_extract('text', c.SAMPLE, 40)} as skills from people_text),
cov as (select query_id, flatten(list(skills)) as covered from orank join own using (id) where rank <= 10 group by 1)
select query_id, array_to_string(list_filter(asked.skills, lambda x: not list_contains(coalesce(covered, []), x)), ',') as gaps
from asked left join cov using (query_id)""")
def jd_gaps(spark, d):
    """Gaps against the ten best term matches of each job."""
    people = c.people_texts(spark, d)
    names = lambda f: F.transform(f, lambda m: m["canonical"])
    own = people.select("id", names(extract_skills(F.col("text"), c.SAMPLE)).alias("skills"))
    todo = jobs_frame(spark, d)
    terms = todo.select(F.col("job_id").alias("query_id"),
                        tx.query_terms(F.col("jd_text")).alias("terms"))
    ranking = lexical.or_rank(terms, lexical.tokenized(people), limit=10)
    wanted = parse_jobs(todo, c.SAMPLE).select(
        F.col("job_id").alias("query_id"), F.col("parsed_jd.skills").alias("skills"))
    return c.flat(jobs.skill_gaps(wanted, ranking.join(own, "id")))
