"""Shared parts of the registered queries: table access, derived texts, SQL pieces.

Texts with names, places and skills are derived from the given tables by expressions that
exist in both dialects, so that their number grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import fixed
from rankspark.functions.dictionary import Skill, SkillDictionary, default_skills

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; a table of fewer files than cores is spread over the cores.

    The test tables are single files with one row group, which one task would read and process
    alone.  Tables of many files are left as they are.
    """
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    heavy = name in ("customer", "documents", "pages", "conversations", "embeddings", "lineitem")
    return frame.repartition(cores) if heavy and len(frame.inputFiles()) < cores else frame


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files.

    A stream's source takes a folder or a pattern, no single file: the pattern here names the table alone.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def flat(frame: DataFrame) -> DataFrame:
    """Integers as bigint, floats as double, string arrays joined - comparable with any engine."""
    out = []
    for f in frame.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "float":
            c = c.cast("double")
        elif kind.startswith("array<"):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return frame.select(*out)


def quoted_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- SQL pieces -----------------------------------------------------------------
STOP = f"[{quoted_list(fixed.STOP_WORDS)}]"
FILLER = f"[{quoted_list(fixed.FILLER_WORDS)}]"


def sql_tokens(text: str) -> str:
    return (
        rf"list_transform(regexp_extract_all(lower(coalesce({text}, '')), "
        rf"'[a-z0-9][a-z0-9+#./\-]*'), lambda x: rtrim(x, '.'))"
    )


def sql_terms(text: str, key: str, source: str, stop: str = STOP, as_key: str = "query_id") -> str:
    """A query giving (query_id, terms): first 12 distinct useful tokens."""
    return f"""
    select {as_key}, list_filter(l, lambda x, i: list_position(l, x) = i)[1:12] as terms
    from (select {key} as {as_key}, list_filter({sql_tokens(text)},
                 lambda x: len(x) > 2 and not list_contains({stop}, x)) as l from {source})"""


BENCH_TERMS = f"""
qterms as ({sql_terms('text', 'item_id', 'benchmark')}),
qt as (select query_id, unnest(terms) as term, generate_subscripts(terms, 1) as pos from qterms)"""

DOC_TOKENS = f"dt as (select doc_id as id, lang, {sql_tokens('text')} as toks from documents)"

TERM_COUNTS = """
occ as (select id, len(toks) as dl, unnest(toks) as term from dt),
tf as (select id, term, any_value(dl) as dl, count(*) as tf from occ
       where term in (select term from qt) group by id, term)"""

BM25 = f"""
with {BENCH_TERMS}, {DOC_TOKENS}, {TERM_COUNTS},
stats as (select count(*) as n, avg(len(toks)) as a from dt),
df as (select term, count(*) as df from tf group by term),
scored as (
  select query_id, id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2)
              / (tf + 1.2 * (1 - 0.75 + 0.75 * greatest(dl, 1) / a))), 6) as score,
    string_agg(term, ',' order by pos) as matched_terms
  from qt join tf using (term) join df using (term) cross join stats group by query_id, id),
bm25 as (select * from (select *, row_number() over (partition by query_id
         order by score desc, id) as rank from scored where score > 0) where rank <= 50)"""

OR_RANK = """
ored as (
  select query_id, id, round(sum(tf) * 0.1, 6) as score,
         string_agg(term, ',' order by pos) as matched_terms
  from qt join tf using (term) group by query_id, id),
orank as (select * from (select *, row_number() over (partition by query_id
          order by score desc, id) as rank from ored) where rank <= 50)"""


def sql_pick(words, key: str) -> str:
    return f"list_extract([{quoted_list(words)}], cast(({key}) % {len(words)} as int) + 1)"


def spark_pick(words, key: str) -> str:
    return f"element_at(array({quoted_list(words)}), cast(({key}) % {len(words)} as int) + 1)"


# --- derived people ----------------------------------------------------------------
HEADLINES = [
    "Senior Backend Engineer", "Data Scientist", "Junior Frontend Developer",
    "Technical Recruiter", "Lead DevOps Engineer", "Product Manager", "QA Analyst",
    "Kubernetes Wizard", "Staff Platform Engineer", "Financial Analyst",
    "Head of Growth", "Fullstack engineer and system thinker", "Intern",
]
LEVELS = ["senior", "mid", "junior", "lead", "staff", "head"]
CITY_LINES = [
    "Based in Dubai, later Berlin.", "Lives in Germany.", "Recruiting in the Gulf area.",
    "No fixed place.", "Moved from new york to Singapore.", "Works from the USA.",
    "Abu Dhabi, United Arab Emirates", "Nordics and DACH teams",
]
SKILL_LINES = [
    "Built python3 and apache spark jobs", "react native apps with react.js and node",
    "Used c++ and asp.net and docker", "Handled compliance and sourcing",
    "k8s, terraform and Machine  Learning", "Plain walks in the park",
    "Star schema design in postgres with SQL",
]
YEARS_LINES = [
    "5+ years of experience", "at least 3 years in the field", "3-6 years on teams",
    "since 2014 and 2019", "10 yrs experience", "graduated, minimum of 2 years", "",
    "from 1998 to 2005 at Acme Freight & Co",
]
DOMAIN_LINES = [
    "in payments and insurance", "for a logistics fleet", "with patient data", "for saas teams",
    "in media and news", "quiet work", "for consulting and advisory", "on solar energy",
]
DEGREE_LINES = ["BSc Physics, Leeds", "", "MBA", "PhD in Logic, 2011"]


def _people_text(pick) -> str:
    newline = "chr(10)"
    parts = [
        "c_name", newline, pick(HEADLINES, "c_custkey"), newline,
        pick(SKILL_LINES, "c_custkey"), "' '", pick(DOMAIN_LINES, "c_custkey + 3"), newline,
        pick(YEARS_LINES, "c_custkey"), newline, pick(CITY_LINES, "c_custkey"), newline,
        pick(DEGREE_LINES, "c_custkey"), "' worked at '", "c_mktsegment", "' Group.'",
    ]
    return " || ".join(parts)


PEOPLE_TEXT_SQL = (
    f"people_text as (select c_custkey as id, {_people_text(sql_pick)} as text from customer)"
)
PEOPLE_SQL = f"""people as (
  select c_custkey as id, c_name as full_name, {sql_pick(HEADLINES, 'c_custkey')} as headline,
         case when c_custkey % 9 = 0 then null else {sql_pick(LEVELS, 'c_custkey')} end as seniority,
         case when c_acctbal < 0 then null else round(c_acctbal / 250, 1) end as years,
         n_name as city, 'COUNTRY_' || (n_nationkey % 7) as country, r_name as region,
         c_mktsegment as industry
  from customer left join nation on c_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey)"""


def people_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey as id", f"{_people_text(spark_pick)} as text"
    )


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as profiles: nation and region are places, the segment is the industry.

    The two place tables stay far below the planner's broadcast threshold.
    """
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    customer = table(spark, folder, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey, "left").selectExpr(
        "c_custkey as id", "c_name as full_name",
        f"{spark_pick(HEADLINES, 'c_custkey')} as headline",
        f"case when c_custkey % 9 = 0 then null else {spark_pick(LEVELS, 'c_custkey')} end "
        "as seniority",
        # scaled, rounded and scaled back, as the SQL rounds a double; a balance of -0.0 keeps its sign
        "case when c_acctbal < 0 then null when c_acctbal = 0 then c_acctbal "
        "else round(c_acctbal / 250 * 10D) / 10D end as years",
        "n_name as city", "'COUNTRY_' || (n_nationkey % 7) as country", "r_name as region",
        "c_mktsegment as industry",
    )


def bought(spark: SparkSession, folder: str) -> DataFrame:
    """(id, canonical, raw): brands and part names a customer bought - its skill mentions."""
    orders, lines, part = (table(spark, folder, n) for n in ("orders", "lineitem", "part"))
    return (
        lines.select("l_orderkey", "l_partkey")
        .join(part.select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("id"), F.lower("p_brand").alias("canonical"),
            F.col("p_name").alias("raw"),
        )
    )


BOUGHT_SQL = """bought as (
  select o_custkey as id, lower(p_brand) as canonical, p_name as raw
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)"""

PEOPLE_SKILLS_SQL = f"""{PEOPLE_SQL}, {BOUGHT_SQL},
people_skills as (select p.*, coalesce(s.skills, []) as skills from people p left join
  (select id, list(distinct canonical) as skills from bought group by id) s using (id))"""


def people_with_skills(spark: SparkSession, folder: str) -> DataFrame:
    # at most one entry per brand a customer ever bought
    skills = bought(spark, folder).groupBy("id").agg(F.collect_set("canonical").alias("skills"))
    none = F.array().cast("array<string>")
    return (
        people(spark, folder).join(skills, "id", "left")
        .withColumn("skills", F.coalesce("skills", none))
    )


# --- skill dictionaries ---------------------------------------------------------------
PROSE = SkillDictionary(
    (
        Skill("article", "grammar", ("the", "a", "der", "la"), ("preposition",)),
        Skill("preposition", "grammar", ("of", "by the", "of the", "in"), ("article", "linker")),
        Skill("linker", "grammar", ("and", "and the", "und", "et"), ("verb",)),
        Skill("verb", "grammar", ("is", "was", "this is", "be"), ()),
        Skill("pronoun", "grammar", ("that", "this", "this is", "que"), ("verb", "article")),
        Skill("r", "letter", ("r",), ("n",)),
        Skill("n", "letter", ("n", "n.", ".de"), ()),
    )
)
SAMPLE = default_skills()


def sql_forms(dictionary: SkillDictionary) -> str:
    """The forms as a list of structs shaped like the state of the fold below."""
    rows = []
    for form, canonical in dictionary.forms():
        escaped = "".join("\\" + ch if not ch.isalnum() and ch not in " _" else ch for ch in form)
        pattern = escaped.replace(" ", r"\s+").replace("'", "''")
        rows.append(f"{{'rest': '', 'found': ['x'][1:0], 'name': '{canonical}', 'form': '{pattern}'}}")
    return "[" + ", ".join(rows) + "]"


def sql_extract(text: str, dictionary: SkillDictionary, cap: int) -> str:
    """Canonical names found in a text, longest form first, found spans blanked."""
    edge = "[^a-zA-Z0-9]"
    pattern = f"'(?i)(^|{edge})(' || x.form || ')($|{edge})'"
    return f"""list_reduce({sql_forms(dictionary)}, lambda acc, x:
      case when len(acc.found) >= {cap} or list_contains(acc.found, x.name) then acc
           when not regexp_matches(acc.rest, {pattern}) then acc
           else {{'rest': regexp_replace(acc.rest, {pattern}, '\\1' || chr(1) || '\\3'),
                  'found': list_append(acc.found, x.name), 'name': '', 'form': ''}} end,
      {{'rest': coalesce({text}, ''), 'found': ['x'][1:0], 'name': '', 'form': ''}}).found"""


def sql_first_class(lowered: str, classes) -> str:
    whens = []
    for label, words in classes:
        test = " or ".join(f"contains({lowered}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words)
        whens.append(f"when {test} then '{label}'")
    return "case " + " ".join(whens) + " end"


def sql_years(text: str) -> str:
    parts = [f"nullif(regexp_extract({text}, '{p}', 1), '')" for p in fixed.YEARS_PATTERNS]
    return f"cast(coalesce({', '.join(parts)}) as double)"


_WORD = r"[\pL\pN_]"
_NOT_WORD = r"[^\pL\pN_]"


def sql_location(text: str, key: str, source: str) -> str:
    """(key, city, country, region): earliest city or country, else the first region group.

    One branch for each place: its patterns are then constants, which engines compile once.
    """
    def named(v):
        return "null" if v is None else f"'{v}'"

    def bounded(alias):
        return f"'(?:^|{_NOT_WORD}){alias}(?:$|{_NOT_WORD})'"

    places = [(alias, city, country, region) for alias, city, country, region in sorted(fixed.CITY_ALIASES, key=lambda r: -len(r[0]))]
    places += [(alias, None, country, None) for alias, country in sorted(fixed.COUNTRY_ALIASES, key=lambda r: -len(r[0]))]
    spots = " union all ".join(f"""
      select id, {i} as ord, {named(city)} as city, {named(country)} as country, {named(region)} as region,
        case when regexp_matches(low, '^{alias}(?:$|{_NOT_WORD})') then 0
             else len(string_split_regex(low, {bounded(alias)})[1]) + 1 end as spot
      from src where contains(low, '{alias}') and regexp_matches(low, {bounded(alias)})"""
                               for i, (alias, city, country, region) in enumerate(places))
    groups = " union all ".join(
        f"select id, {j} as ord, '{name}' as region from src where contains(low, '{alias}') and regexp_matches(low, {bounded(alias)})"
        for j, (alias, name) in enumerate(fixed.REGION_ALIASES))
    return f"""
    with src as (select {key} as id, lower(coalesce({text}, '')) as low from {source}),
    spots as ({spots}),
    best as (select id, arg_min({{'city': city, 'country': country, 'region': region}},
                                {{'spot': spot, 'ord': ord}}) as p from spots group by id),
    fallback as (select id, arg_min(region, ord) as region from ({groups}) group by id)
    select src.id, best.p.city as city, best.p.country as country,
           case when best.id is not null then best.p.region else fallback.region end as region
    from src left join best using (id) left join fallback using (id)"""
