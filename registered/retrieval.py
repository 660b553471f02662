"""Lexical and vector retrieval, embedding, fusion."""

from pyspark.sql import functions as F

from rankspark.functions import text as tx
from rankspark.operators import embedding, filters, fusion, lexical, vector
from rankspark.plans.index import LexicalIndex
from rankspark.plans.search import as_profiles
from rankspark.plans.segments import SegmentedIndex
from rankspark.plans.vector_index import VectorIndex, recall
from rankspark.session import scratch_dir, written

from . import common as c

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def documents(spark, d):
    return lexical.tokenized(c.table(spark, d, "documents"), "doc_id")


def bench_terms(spark, d):
    return c.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), tx.query_terms(F.col("text")).alias("terms"))


# --- statistics ---------------------------------------------------------------------
@query("corpus_stats", f"""with {c.DOC_TOKENS}
select count(*) as n_docs, round(avg(len(toks)), 6) as avg_dl from dt""")
def corpus_stats(spark, d):
    return lexical.collection_stats(documents(spark, d)).withColumn("avg_dl", F.round("avg_dl", 6))


@query("doc_frequency", f"""with {c.DOC_TOKENS}, o as (select id, unnest(toks) as term from dt)
select term, count(distinct id) as df, count(*) as cf from o group by term""")
def doc_frequency(spark, d):
    return c.flat(lexical.document_frequency(documents(spark, d)))


@query("postings_build", f"""with {c.DOC_TOKENS},
o as (select id, len(toks) as dl, unnest(toks) as term from dt),
p as (select term, id, count(*) as tf, any_value(dl) as dl from o group by term, id)
select term[1:1] as initial, count(*) as n_postings, sum(tf)::bigint as sum_tf, sum(dl)::bigint as sum_dl,
  max(tf) as max_tf, sum(id * tf)::bigint as id_checksum from p group by 1""")
def postings_build(spark, d):
    rows = lexical.postings(documents(spark, d))
    return c.flat(rows.groupBy(F.substring("term", 1, 1).alias("initial")).agg(
        F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("sum_tf"),
        F.sum("dl").alias("sum_dl"), F.max("tf").alias("max_tf"),
        F.sum(F.col("id") * F.col("tf")).alias("id_checksum")))


# --- ranking ------------------------------------------------------------------------
@query("bm25_topk", c.BM25 + " select query_id, id, rank, score, matched_terms from bm25")
def bm25_topk(spark, d):
    return c.flat(lexical.bm25(bench_terms(spark, d), documents(spark, d)))


@query("bm25_indexed", c.BM25 + " select query_id, id, rank, score, matched_terms from bm25")
def bm25_indexed(spark, d):
    """The same answer from a stored index: postings are written once, then read by term bucket."""
    path = scratch_dir(spark)
    pool = c.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    LexicalIndex.write(pool, path)
    return c.flat(LexicalIndex.read(spark, path).bm25(bench_terms(spark, d)))


@query("bm25_incremental", c.BM25 + " select query_id, id, rank, score, matched_terms from bm25")
def bm25_incremental(spark, d):
    """The same answer from an index that grew: added in two parts, a fifth of it with other texts that are
    replaced later, and rows that are deleted again."""
    pool = c.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    index = SegmentedIndex(spark, scratch_dir(spark), buckets=8)
    index.add(pool.where("id % 5 < 2").withColumn("text", F.when(F.col("id") % 5 == 0, F.reverse("text")).otherwise(F.col("text"))))
    index.add(pool.where("id % 5 <> 1").unionByName(pool.select((-F.col("id") - 1).alias("id"), "text")))
    index.delete(pool.select((-F.col("id") - 1).alias("id")))
    return c.flat(index.bm25(bench_terms(spark, d)))


@query("bm25_pruned", c.BM25 + " select query_id, id, rank, score, matched_terms from bm25")
def bm25_pruned(spark, d):
    """The same answer, scoring only blocks whose bound reaches the last hit."""
    index = SegmentedIndex(spark, scratch_dir(spark), buckets=8)
    index.add(c.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return c.flat(index.bm25_pruned(bench_terms(spark, d))[0])


_LANGS = ["en", "fr", "de", "es"]
_SCOPED = f"""
with {c.BENCH_TERMS}, {c.DOC_TOKENS},
ql as (select qt.*, {c.sql_pick(_LANGS, 'query_id')} as lang from qt),
occ as (select id, lang, len(toks) as dl, unnest(toks) as term from dt),
tf as (select id, lang, term, any_value(dl) as dl, count(*) as tf from occ
       where term in (select term from qt) group by id, lang, term),
stats as (select lang, count(*) as n, avg(len(toks)) as a from dt group by lang),
df as (select lang, term, count(*) as df from tf group by lang, term),
scored as (select query_id, id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2)
              / (tf + 1.2 * (1 - 0.75 + 0.75 * greatest(dl, 1) / a))), 6) as score,
    string_agg(term, ',' order by pos) as matched_terms
  from ql join tf using (lang, term) join df using (lang, term) join stats using (lang)
  group by query_id, id)
select query_id, id, rank, score, matched_terms from (select *, row_number() over (partition by query_id
  order by score desc, id) as rank from scored where score > 0) where rank <= 50"""


@query("bm25_filtered", _SCOPED)
def bm25_filtered(spark, d):
    """Each query is restricted to one language (a profile's industry); statistics follow."""
    none = "cast(null as array<string>)"
    asked = bench_terms(spark, d).withColumn("filters", F.expr(
        f"named_struct('skills', {none}, 'min_years', cast(null as double), 'max_years', cast(null as double), "
        f"'seniority', {none}, 'cities', {none}, 'countries', {none}, 'region', cast(null as string), "
        f"'industry', {c.spark_pick(_LANGS, 'query_id')}, 'family', cast(null as string))"))
    pool = as_profiles(c.table(spark, d, "documents"), id=F.col("doc_id"), industry=F.col("lang"))
    pool = pool.withColumn("skills", F.array().cast("array<string>"))
    docs = lexical.tokenized(filters.eligible(asked, pool, keep=["text"]), keep=["scope"])
    scoped = asked.withColumn(
        "scope", filters.filter_scope(filters.clean_filters(F.col("filters"))))
    return c.flat(lexical.bm25(scoped, docs))


@query("fts_or_rank", f"""with {c.BENCH_TERMS}, {c.DOC_TOKENS}, {c.TERM_COUNTS}, {c.OR_RANK}
select query_id, id, rank, score, matched_terms from orank""")
def fts_or_rank(spark, d):
    return c.flat(lexical.or_rank(bench_terms(spark, d), documents(spark, d)))


# --- vectors ------------------------------------------------------------------------
def vectors(spark, d):
    return c.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label")


_COSINE = """round(case when sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) = 0 then 0
  else list_cosine_similarity(a.e, b.e) end, 6)"""
_VEC = "v as (select vec_id, label, embedding::double[] as e from embeddings)"


@query("vector_topk", f"""with {_VEC},
s as (select a.vec_id as query_id, b.vec_id as id, {_COSINE} as score from v a cross join v b)
select query_id, id, rank, score from (select *, row_number() over (partition by query_id
  order by score desc, id) as rank from s) where rank <= 50""")
def vector_topk(spark, d):
    pool = vectors(spark, d)
    queries = pool.select(F.col("id").alias("query_id"), "embedding")
    return c.flat(vector.vector_topk(queries, pool))


@query("vector_topk_restricted", f"""with {_VEC},
s as (select a.vec_id as query_id, b.vec_id as id, {_COSINE} as score from v a join v b on b.label = a.label)
select query_id, id, rank, score from (select *, row_number() over (partition by query_id
  order by score desc, id) as rank from s) where rank <= 10""")
def vector_topk_restricted(spark, d):
    pool = vectors(spark, d).withColumn("scope", F.col("label").cast("string"))
    queries = pool.select(F.col("id").alias("query_id"), "scope", "embedding")
    return c.flat(vector.vector_topk(queries, pool, k=10))


@query("vector_topk_blocks", f"""with {_VEC},
s as (select a.vec_id as query_id, b.vec_id as id, {_COSINE} as score from v a cross join v b)
select query_id, id, rank, score from (select *, row_number() over (partition by query_id
  order by score desc, id) as rank from s) where rank <= 10""")
def vector_topk_blocks(spark, d):
    """The variant for query tables too large to send to the tasks."""
    pool = vectors(spark, d)
    queries = pool.select(F.col("id").alias("query_id"), "embedding")
    return c.flat(vector.vector_topk(queries, pool, k=10, sent_queries=0))


@query("vector_decode", """
with t as (select vec_id, label, embedding::double[] as e from embeddings)
select vec_id, len(e)::bigint as dims, round(list_sum(e), 4) as total, round(e[1], 6) as first_value from t
where label % 5 not in (1, 2)""")
def vector_decode(spark, d):
    """Vectors from JSON text: missing (label 1, 6) and malformed (label 2, 7) rows are skipped."""
    text = F.when(F.col("label") % 5 == 1, F.lit(None)).when(
        F.col("label") % 5 == 2, F.lit("[0.1, oops")).otherwise(F.to_json("embedding"))
    rows = vectors(spark, d).select(F.col("id").alias("vec_id"), text.alias("stored"))
    e = F.transform("embedding", lambda v: v.cast("double"))
    return c.flat(vector.decode_vectors(rows, "stored").select(
        "vec_id", F.size("embedding").cast("bigint").alias("dims"),
        F.round(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), 4).alias("total"),
        F.round(F.get(e, F.lit(0)), 6).alias("first_value")))


@query("ann_topk")
def ann_topk(spark, d):
    pool = vectors(spark, d)
    queries = pool.select(F.col("id").alias("query_id"), "embedding")
    return c.flat(vector.ann_topk(queries, pool, dims=64, k=10))


def _vector_index(spark, d):
    path, pool = scratch_dir(spark), vectors(spark, d)
    VectorIndex.write(pool, path)
    asked = pool.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    return VectorIndex.read(spark, path), asked, pool


@query("ann_index_topk")
def ann_index_topk(spark, d):
    """Ten nearest vectors of every fiftieth, from the stored index; approximate, see ann_index_recall."""
    index, asked, _ = _vector_index(spark, d)
    return c.flat(index.search(asked, 10))


@query("ann_index_recall", """
select count(*) as n_queries, true as recall_reached, true as few_full_vectors from embeddings where vec_id % 50 = 0""")
def ann_index_recall(spark, d):
    """The index against exact search: recall of at least 0.9, at most a tenth of the full vectors compared."""
    index, asked, pool = _vector_index(spark, d)
    row = recall(index.search(asked, 10), vector.vector_topk(asked, pool, 10))
    few = index.settings["rerank"] <= 0.1 * index.settings["n_vectors"]
    return c.flat(row.select("n_queries", (F.col("recall") >= 0.9).alias("recall_reached"), F.lit(few).alias("few_full_vectors")))


def _md5_number(value: str, start: int) -> str:
    return f"cast(concat('0x', substr({value}, {start}, 8)) as ubigint)"


def _features(dictionary) -> str:
    rows = [f"('{token}', '{feature}', {weight})"
            for token, extra in dictionary.token_features().items() for feature, weight in extra]
    return ", ".join(rows)


def sql_embedding(source: str, dims: int = 384, name: str = "emb") -> str:
    """CTEs giving ``name``(id, bucket, value) - unit vectors - from ``source``(id, toks)."""
    return f"""
{name}_extra(token, feature, weight) as (values {_features(c.SAMPLE)}),
{name}_tok as (select id, token, count(*) as n from (select id, unnest(toks) as token from {source}) group by id, token),
{name}_feat as (select id, token as feature, n * 1.0::double as w from {name}_tok union all
  select id, feature, n * weight::double from {name}_tok join {name}_extra using (token)),
{name}_sum as (select id, feature, sum(w) as w from {name}_feat group by id, feature),
{name}_dig as (select distinct feature, md5(feature) as h from {name}_sum),
{name}_put as (select feature, {_md5_number('h', 1)} % {dims} as one, {_md5_number('h', 9)} % {dims} as two,
  case when {_md5_number('h', 9)} // 16777216 % 2 = 0 then 1.0::double else -1.0::double end as sign from {name}_dig),
{name}_raw as (select id, one as bucket, w * sign as v from {name}_sum join {name}_put using (feature) union all
  select id, two, w * sign * 0.5 from {name}_sum join {name}_put using (feature)),
{name}_acc as (select id, bucket::bigint as bucket, sum(v) as v from {name}_raw group by id, bucket),
{name}_norm as (select id, sqrt(sum(v * v)) as norm from {name}_acc group by id),
{name} as (select id, bucket, v / norm as value from {name}_acc join {name}_norm using (id) where norm > 0)"""


@query("hash_embed", f"""with {c.DOC_TOKENS}, {sql_embedding('dt')}
select id, bucket, round(value, 6) as value from emb where round(value, 6) <> 0""")
def hash_embed(spark, d):
    texts = c.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    embedded = embedding.hash_embedder(c.SAMPLE, digest="md5", value_type="double")(texts)
    rows = embedded.select("id", F.posexplode("embedding").alias("bucket", "v"))
    value = F.round(F.col("v"), 6)
    return c.flat(rows.select("id", "bucket", value.alias("value")).where(F.col("value") != 0))


# --- fusion -----------------------------------------------------------------------------
def two_rankings(spark, d):
    queries, docs = bench_terms(spark, d), written(documents(spark, d))  # tokenised once, for three passes
    columns = ["query_id", "retriever", "id", "rank", "score"]
    one = lexical.bm25(queries, docs).withColumn("retriever", F.lit("bm25"))
    two = lexical.or_rank(queries, docs, matrix=True).withColumn("retriever", F.lit("or"))
    return one.select(*columns).unionByName(two.select(*columns))


def _sql_fused(w_bm25: str, w_or: str) -> str:
    return f"""{c.BM25}, {c.OR_RANK},
hits as (select query_id, id, rank, score, 'bm25' as retriever from bm25 union all
         select query_id, id, rank, score, 'or' from orank),
fused as (select query_id, id, round(sum(case retriever when 'bm25' then {w_bm25} else {w_or} end / (60 + rank)), 8) as score,
  max(case when retriever = 'bm25' then rank end) as bm25_rank, max(case when retriever = 'or' then rank end) as or_rank,
  max(case when retriever = 'or' then score end) as or_score from hits group by query_id, id)"""


def _fused_columns(fused):
    get = lambda m, n: F.try_element_at(F.col(m), F.lit(n))
    return c.flat(fused.select(
        "query_id", "id", "score", "fused_rank", get("ranks", "bm25").alias("bm25_rank"),
        get("ranks", "or").alias("or_rank"), get("raw_scores", "or").alias("or_score")))


_POSITION = "row_number() over (partition by query_id order by score desc, id) as fused_rank"


@query("rrf_fuse", _sql_fused("1.0::double", "1.0::double") + f"""
select query_id, id, score, {_POSITION}, bm25_rank, or_rank, or_score from fused""")
def rrf_fuse(spark, d):
    return _fused_columns(fusion.reciprocal_rank_fusion(two_rankings(spark, d)))


@query("rrf_weighted", _sql_fused("2.0::double", "1.0::double") + f"""
select query_id, id, score, {_POSITION}, bm25_rank, or_rank, or_score from fused""")
def rrf_weighted(spark, d):
    return _fused_columns(
        fusion.reciprocal_rank_fusion(two_rankings(spark, d), weights={"bm25": 2.0}))


@query("minmax_normalize", _sql_fused("1.0::double", "1.0::double") + """
select query_id, id, round(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end, 6) as normalized, total from (
  select *, max(score) over (partition by query_id) as hi, min(score) over (partition by query_id) as lo,
  count(*) over (partition by query_id) as total from fused)""")
def minmax_normalize(spark, d):
    fused = fusion.reciprocal_rank_fusion(two_rankings(spark, d))
    return c.flat(fused.select("query_id", "id", F.round("normalized", 6).alias("normalized"), "total"))
