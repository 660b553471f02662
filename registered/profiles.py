"""Hard filters, reranking features, pages and details over customers as profiles."""

from pyspark.sql import functions as F

from rankspark.functions import fixed
from rankspark.functions.text import round_half
from rankspark.operators import filters, rerank
from rankspark.operators.shape import top_k
from rankspark.plans.search import as_profiles
from rankspark.sources import tables

from . import common as c

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def asked(spark, **filter_lists):
    """Filters given by name as a queries frame (query_id, filters)."""
    rows = [(i, f) for i, f in enumerate(filter_lists["filters"])]
    full = [(i, {n: f.get(n) for n in filters.FILTER_FIELDS}) for i, f in rows]
    return spark.createDataFrame(full, f"query_id bigint, filters {filters.FILTER_TYPE}")


def _eligible(spark, d, filter_list):
    pool = c.people_with_skills(spark, d)
    return filters.eligible_ids(asked(spark, filters=filter_list), pool)


def _sql_eligible(conditions) -> str:
    parts = [f"select {i}::bigint as query_id, id from people_skills where {cond}"
             for i, cond in enumerate(conditions)]
    return f"with {c.PEOPLE_SKILLS_SQL} " + " union all ".join(parts)


@query("filter_all_of", _sql_eligible([
    "list_has_all(skills, ['brand#1', 'brand#2', 'brand#3'])", "list_has_all(skills, ['brand#7'])"]))
def filter_all_of(spark, d):
    return _eligible(spark, d, [{"skills": ["Brand#1", "brand#2", "BRAND#3", "brand#1"]},
                                {"skills": ["brand#7"]}])


@query("filter_range", _sql_eligible([
    "years >= 10", "years <= 5", "years between 8 and 30", "seniority in ('senior', 'lead')",
    "years >= 20 and seniority in ('staff')", "years >= 9 and years <= 3"]))
def filter_range(spark, d):
    return _eligible(spark, d, [
        {"min_years": 10.0}, {"max_years": 5.0}, {"min_years": 8.0, "max_years": 30.0},
        {"seniority": ["senior", "lead"]}, {"min_years": 20.0, "seniority": ["staff"]},
        {"min_years": 9.0, "max_years": 3.0}])


@query("filter_geo_or", _sql_eligible([
    "city in ('NATION_3', 'NATION_4') or country in ('COUNTRY_1') or region = 'ASIA'",
    "city = 'NATION_8'", "country in ('COUNTRY_2', 'COUNTRY_3')"]))
def filter_geo_or(spark, d):
    return _eligible(spark, d, [
        {"cities": ["NATION_3", "NATION_4"], "countries": ["COUNTRY_1"], "region": "ASIA"},
        {"cities": ["NATION_8"]}, {"countries": ["COUNTRY_2", "COUNTRY_3"]}])


@query("filter_ilike_any", _sql_eligible([
    "headline ilike '%devops%' or headline ilike '%sre%' or headline ilike '%site reliability%' or headline ilike '%platform engineer%' or headline ilike '%cloud engineer%' or headline ilike '%infrastructure engineer%'",
    "headline ilike '%wizard%'", "headline ilike '%fullstack%' or headline ilike '%full-stack%' or headline ilike '%full stack%'"]))
def filter_ilike_any(spark, d):
    return _eligible(spark, d, [{"family": "devops engineer"}, {"family": "WIZARD"},
                                {"family": "fullstack engineer"}])


@query("filter_combined", _sql_eligible([
    "list_has_all(skills, ['brand#5']) and years >= 4 and seniority in ('mid', 'senior') and (region = 'EUROPE' or city = 'NATION_1') and industry = 'BUILDING'",
    "industry = 'FURNITURE' and (headline ilike '%recruiter%' or headline ilike '%sourcer%' or headline ilike '%talent acquisition%' or headline ilike '%talent partner%' or headline ilike '%recruiting%')",
    "industry = 'nothing like it'"]))
def filter_combined(spark, d):
    """The third filter matches nobody; the fourth query has no constraint and is not restricted."""
    return _eligible(spark, d, [
        {"skills": ["brand#5"], "min_years": 4.0, "seniority": ["mid", "senior"],
         "region": "EUROPE", "cities": ["NATION_1"], "industry": "BUILDING"},
        {"industry": "FURNITURE", "family": "recruiter"}, {"industry": "nothing like it"},
        {"skills": [], "region": "", "cities": []}])


@query("filter_pushdown", f"""with {c.PEOPLE_SKILLS_SQL} select id from people_skills
where years >= 4 and industry = 'BUILDING' and seniority in ('senior') and list_has_all(skills, ['brand#5'])""")
def filter_pushdown(spark, d):
    pool = c.people_with_skills(spark, d)
    return filters.where_filter(pool, {
        "skills": ["Brand#5"], "min_years": 4, "industry": "BUILDING", "seniority": ["senior"],
        "cities": [], "region": ""}).select("id")


@query("list_page", f"""with {c.PEOPLE_SQL},
m as (select * from people where full_name ilike '%0001%' or headline ilike '%0001%')
select id, full_name, headline, (select count(*) from m) as total from m order by id limit 20 offset 5""")
def list_page(spark, d):
    page = tables.list_page(c.people(spark, d), text="0001", limit=20, offset=5)
    return page.select("id", "full_name", "headline", "total")


@query("list_page_skill", f"""with {c.PEOPLE_SQL}, {c.BOUGHT_SQL},
m as (select * from people where id in (select id from bought where raw ilike '%red wid%'))
select id, full_name, (select count(*) from m) as total from m order by id limit 50 offset 0""")
def list_page_skill(spark, d):
    mentions = c.bought(spark, d).withColumnRenamed("id", "candidate_id")
    page = tables.list_page(c.people(spark, d), skill="RED wid", mentions=mentions)
    return page.select("id", "full_name", "total")


@query("profile_detail", f"""with {c.PEOPLE_SQL},
roles as (select o_custkey as id, string_agg(o_orderpriority || ':' || o_orderstatus, ';' order by o_orderkey) as experiences, count(*) as n from orders group by 1),
sk as (select o_custkey as id, array_to_string((list(distinct lower(o_orderpriority) order by lower(o_orderpriority)))[1:12], ',') as skills from orders group by 1)
select people.id, full_name, concat_ws(', ', city, country) as label, industry, coalesce(experiences, '') as experiences, coalesce(n, 0) as n_experiences, coalesce(skills, '') as skills
from people left join roles using (id) left join sk using (id)""")
def profile_detail(spark, d):
    orders = c.table(spark, d, "orders")
    roles = orders.select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("sort_order"),
                          F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("title"))
    mentions = orders.select(
        F.col("o_custkey").alias("candidate_id"), F.lower("o_orderpriority").alias("canonical")
    ).distinct().select("candidate_id", "canonical", F.col("canonical").alias("raw"),
                        F.lit(0).alias("sort_order"))
    detail = tables.profile_detail(c.people(spark, d), mentions, roles)
    return c.flat(detail.select(
        "id", "full_name", F.concat_ws(", ", "city", "country").alias("label"), "industry",
        F.coalesce(F.array_join("experiences.title", ";"), F.lit("")).alias("experiences"),
        F.greatest(F.coalesce(F.size("experiences"), F.lit(0)), F.lit(0)).alias("n_experiences"),
        F.coalesce(F.array_join(F.slice("skills", 1, 12), ","), F.lit("")).alias("skills")))


# --- rerank ---------------------------------------------------------------------------
@query("years_fit", f"""with {c.PEOPLE_SQL},
r as (select *, case when id % 3 = 0 then null else (id % 12)::double end as lo, case when id % 4 = 0 then null else (id % 12 + 5)::double end as hi from people)
select id, round(case when years is null or (lo is null and hi is null) then 0.5
  when years < lo then greatest(0, 1 - (lo - years) / greatest(lo, 1)) when years > hi then greatest(0, 1 - (years - hi) / greatest(hi, 1)) else 1 end, 4)::double as fit,
  case when years is null or (lo is null and hi is null) then null
   when years < lo then printf('%g', years) || ' yrs — below the ' || printf('%g', lo) || '+ the query asks for'
   when years > hi then printf('%g', years) || ' yrs — above the ' || printf('%g', hi) || ' ceiling'
   else printf('%g', years) || ' yrs of experience fits the range' end as note from r""")
def years_fit(spark, d):
    rows = c.people(spark, d).selectExpr(
        "id", "years", "case when id % 3 = 0 then null else double(id % 12) end as lo",
        "case when id % 4 = 0 then null else double(id % 12 + 5) end as hi")
    args = (F.col("years"), F.col("lo"), F.col("hi"))
    return rows.select("id", round_half(rerank.years_fit(*args), 4).alias("fit"),
                       rerank.years_note(*args).alias("note"))


def _intent_rows(spark, d):
    """Profiles with an intent each, varied by id."""
    rows = c.people_with_skills(spark, d)
    return rows.withColumn("intent", F.expr("""named_struct(
      'min_years', case when id % 3 = 0 then null else double(id % 12) end,
      'max_years', case when id % 4 = 0 then null else double(id % 12 + 5) end,
      'cities', case when id % 5 = 0 then array('nation_3', 'Nation_8', 'NATION_12', upper(city)) end,
      'countries', case when id % 5 = 1 then array('COUNTRY_1', 'country_2') end,
      'region', case when id % 5 in (1, 2) then 'ASIA' end,
      'family', case when id % 6 = 0 then null when id % 2 = 0 then 'devops engineer' else 'data scientist' end,
      'skills', case when id % 7 = 0 then cast(array() as array<string>) else array('brand#1', 'brand#2', 'brand#9', 'none') end)"""))


_INTENT_SQL = f"""{c.PEOPLE_SKILLS_SQL},
x as (select *, case when id % 3 = 0 then null else (id % 12)::double end as lo, case when id % 4 = 0 then null else (id % 12 + 5)::double end as hi,
  case when id % 5 = 0 then true when id % 5 = 1 then false end as by_city,
  case when id % 6 = 0 then null when id % 2 = 0 then 'devops engineer' else 'data scientist' end as asked_family,
  ' ' || lower(coalesce(headline, '')) || ' ' as padded from people_skills),
g as (select *, case when id % 5 = 0 and city is not null then 'city' when id % 5 = 1 and country in ('COUNTRY_1', 'COUNTRY_2') then 'country'
  when id % 5 in (1, 2) and region = 'ASIA' then 'region' end as geo,
  coalesce({c.sql_first_class('padded', fixed.TITLE_FAMILIES)}, ({c.sql_extract('headline', c.SAMPLE, 3)})[1] || ' specialist') as own_family from x),
f as (select *, case geo when 'city' then 1.40 when 'country' then 1.35 when 'region' then 1.35 else 1.0 end::double as geo_factor,
  case when asked_family is null then 0.5 when own_family = asked_family then 1 else 0 end::double as title_family,
  case when id % 7 = 0 then 0.5 else round(len(list_filter(['brand#1', 'brand#2', 'brand#9', 'none'], lambda s: list_contains(skills, s))) / 4.0, 4) end::double as skill_overlap,
  round(case when years is null or (lo is null and hi is null) then 0.5 when years < lo then greatest(0, 1 - (lo - years) / greatest(lo, 1))
    when years > hi then greatest(0, 1 - (years - hi) / greatest(hi, 1)) else 1 end, 4)::double as years_fit,
  round((id % 101) / 100.0, 4)::double as fusion from g),
r as (select *, round((0.55 * fusion + 0.17 * title_family + 0.15 * skill_overlap + 0.13 * years_fit) * geo_factor, 6) as score from f)"""


@query("geo_factor", f"""with {_INTENT_SQL} select id, geo, geo_factor,
 case geo when 'city' then 'based in ' || city || ', as requested (geo boost ×1.40)' when 'country' then 'based in ' || country || ', as requested (geo boost ×1.35)'
  when 'region' then 'based in ' || region || ' (region), as requested (geo boost ×1.35)' else case when id % 5 <= 2 then 'outside the requested geography' end end as note from f""")
def geo_factor(spark, d):
    match = rerank.geo_match(F.col("city"), F.col("country"), F.col("region"), F.col("intent"))
    rows = _intent_rows(spark, d).withColumn("geo", match)
    return rows.select("id", "geo", rerank.geo_factor(F.col("geo")).alias("geo_factor"),
                       rerank.geo_note(F.col("geo"), F.col("intent")).alias("note"))


def _features(spark, d):
    fusion_score = F.col("id") % 101 / 100.0
    return _intent_rows(spark, d).withColumn(
        "features", rerank.rerank_features(fusion_score, c.SAMPLE))


@query("rerank_features", f"""with {_INTENT_SQL}
select id, fusion, title_family, skill_overlap, years_fit, geo_factor, score from r""")
def rerank_features(spark, d):
    return _features(spark, d).select("id", *[F.col(f"features.{n}").alias(n) for n in (
        "fusion", "title_family", "skill_overlap", "years_fit", "geo_factor", "score")])


@query("rerank_topn", f"""with {_INTENT_SQL}
select industry, rank, id, score from (select *, row_number() over (partition by industry order by score desc, id) as rank from r) where rank <= 20""")
def rerank_topn(spark, d):
    rows = _features(spark, d).select("industry", "id", F.col("features.score").alias("score"))
    return c.flat(top_k(rows, ["industry"], [F.desc("score"), F.asc("id")], 20))


@query("soft_or_hard", f"""with {c.PEOPLE_SQL}
select id, case when id % 2 = 0 then 7.0 else years end::double as min_years,
  case when id % 3 = 0 then region else city end as place, case when id % 5 = 0 then 'given' else industry end as family from people""")
def soft_or_hard(spark, d):
    """Explicit values win, empty ones fall back to the parse."""
    rows = c.people(spark, d).withColumns({
        "parsed": F.expr("""named_struct('skills', array('x'), 'min_years', years, 'max_years', cast(null as double),
            'seniority', array(seniority), 'city', city, 'country', country, 'region', region,
            'industry', industry, 'family', industry)"""),
        "filters": filters.clean_filters(F.expr("""named_struct('skills', cast(array() as array<string>),
            'min_years', if(id % 2 = 0, 7.0D, null), 'max_years', cast(null as double), 'seniority', cast(array() as array<string>),
            'cities', if(id % 3 = 0, array(region), cast(array() as array<string>)), 'countries', cast(array() as array<string>),
            'region', '', 'industry', '', 'family', if(id % 5 = 0, 'given', ''))""")),
    }).withColumn("intent", rerank.intent_of(F.col("parsed"), F.col("filters")))
    return rows.select("id", "intent.min_years", F.get("intent.cities", F.lit(0)).alias("place"),
                       "intent.family")
