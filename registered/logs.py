"""Search log, saved searches, runs, dimensions, counts, incremental plans, streams."""

import os

from pyspark.sql import functions as F

from rankspark.functions.text import content_hash
from rankspark.operators import embedding
from rankspark.plans import ingest
from rankspark.session import scratch_dir
from rankspark.sources import tables
from rankspark.sources.keyed import KeyedTable
from rankspark.streaming import jobs

from . import common as c

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def _log(spark, d):
    return c.table(spark, d, "events").select(
        F.col("event_id").alias("query_id"), F.col("ts").alias("created_at"),
        F.col("user_id").alias("saved_id"), "event_type", "value",
        F.from_json("props", "k int")["k"].alias("k"))


_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("log_recent", f"""select event_id as query_id, {_STAMP} as created_at, event_type from events order by ts desc limit 20""")
def log_recent(spark, d):
    return tables.recent(_log(spark, d)).select(
        "query_id", F.date_format("created_at", _FORMAT).alias("created_at"), "event_type")


@query("search_snapshot", """
with q as (select event_id as query_id, event_type from events),
r as (select user_id * 10 as query_id, row_number() over (partition by user_id order by value desc, event_id) as rank, event_id as id, value as score from events)
select query_id, event_type, rank, id, score from q join r using (query_id) where rank <= 20""")
def search_snapshot(spark, d):
    """Logged results (a user's events by value) belong to the query numbered ten times the user."""
    log = _log(spark, d)
    lines = log.select((F.col("saved_id") * 10).alias("query_id"), F.col("query_id").alias("id"),
                       F.col("value").alias("score"))
    from rankspark.operators.shape import top_k
    lines = top_k(lines, ["query_id"], [F.desc("score"), F.asc("id")], tables.LOGGED_RESULTS)
    heads = log.select("query_id", "event_type")
    return c.flat(tables.snapshot(heads, lines).select("query_id", "event_type", "rank", "id", "score"))


@query("saved_run_stats", f"""
with s as (select distinct user_id as saved_id from events union select -1 - c_custkey from customer),
r as (select user_id as saved_id, count(*) as run_count, max(ts) as ts from events where event_type in ('view', 'click') group by 1)
select s.saved_id, coalesce(run_count, 0) as run_count, {_STAMP} as last_run_at from s left join r using (saved_id)""")
def saved_run_stats(spark, d):
    log = _log(spark, d)
    never = c.table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("saved_id"))
    saved = log.select("saved_id").distinct().unionByName(never)
    stats = tables.saved_run_stats(saved, log.where(F.col("event_type").isin("view", "click")))
    return stats.withColumn("last_run_at", F.date_format("last_run_at", _FORMAT))


@query("latest_run", f"""select event_id as query_id, {_STAMP} as created_at, user_id as saved_id, event_type, value, json_extract(props, '$.k')::bigint as k from events order by ts desc limit 1""")
def latest_run(spark, d):
    newest = tables.latest(_log(spark, d))
    return c.flat(newest.withColumn("created_at", F.date_format("created_at", _FORMAT)))


@query("search_log_write", f"""
with r as (select user_id as query_id, event_id as id, value as score, row_number() over (partition by user_id order by value desc, event_id) as rank,
  count(*) over (partition by user_id) as result_count, max(ts) over (partition by user_id) as created from events)
select query_id, result_count, cast(created as date)::varchar as day, id, rank, score, json_object('rank', rank, 'score', score)::varchar as components
from r where rank <= 20""")
def search_log_write(spark, d):
    """Both log tables are appended as files partitioned by day, and read back."""
    from rankspark.operators.shape import top_k
    log = _log(spark, d)
    when = log.groupBy("saved_id").agg(F.max("created_at").alias("created_at"))
    results = top_k(
        log.select(F.col("saved_id").alias("query_id"), F.col("query_id").alias("id"),
                   F.col("value").alias("score")),
        ["query_id"], [F.desc("score"), F.asc("id")], 1_000_000_000,
    ).withColumn("components", F.struct("rank", "score"))
    results = results.join(when.withColumnRenamed("saved_id", "query_id"), "query_id")
    queries = when.select(F.col("saved_id").alias("query_id"), F.lit("").alias("raw_query"),
                          "created_at")
    path = scratch_dir(spark)
    tables.append_log(tables.log_frames(results, queries, "hybrid", True, F.col("created_at")), path)
    heads, lines = (spark.read.parquet(f"{path}/{n}") for n in ("queries", "results"))
    return c.flat(heads.select("query_id", "result_count", F.col("day").cast("string").alias("day")).join(
        lines.select("query_id", "id", "rank", "score", F.to_json("components").alias("components")),
        "query_id"))


@query("table_counts", " union all ".join(
    f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in c.TABLES))
def table_counts(spark, d):
    return tables.table_counts({t: spark.read.parquet(f"{d}/{t}.parquet") for t in c.TABLES})


_KEY = "md5(concat_ws(chr(31), city, country))"


@query("dim_get_or_create", f"""
with dim as (select -1 - n_nationkey::bigint as location_id, n_name as city, 'COUNTRY_' || (n_nationkey % 7) as country, r_name as region
   from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0),
incoming as (select coalesce(n_name, 'Unknown') as city, case when c_custkey % 10 = 0 then 'Unknown' else 'COUNTRY_' || (n_nationkey % 7) end as country,
   r_name || '/' || c_mktsegment as region, c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
fresh as (select city, country, arg_min(region, c_custkey) as region from incoming group by city, country)
select * from dim union all
select cast(concat('0x', {_KEY}[1:15]) as ubigint)::bigint, city, country, region from fresh f where not exists (select 1 from dim where dim.city = f.city and dim.country = f.country)""")
def dim_get_or_create(spark, d):
    nation, region = c.table(spark, d, "nation"), c.table(spark, d, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    country = "'COUNTRY_' || (n_nationkey % 7)"
    dim = places.where("n_nationkey % 2 = 0").selectExpr(
        "-1 - bigint(n_nationkey) as location_id", "n_name as city", f"{country} as country",
        "r_name as region")
    customer = c.table(spark, d, "customer")
    incoming = customer.join(places, customer.c_nationkey == places.n_nationkey).selectExpr(
        "n_name as city", f"case when c_custkey % 10 = 0 then null else {country} end as country",
        "r_name || '/' || c_mktsegment as region", "c_custkey")
    return tables.get_or_create(dim, incoming, ["city", "country"], "location_id", "c_custkey")


@query("saved_delete", """select event_id as id, event_type from events
where event_id not in (select o_orderkey from orders where o_orderstatus = 'F')""")
def saved_delete(spark, d):
    gone = c.table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id"))
    log = c.table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    return tables.delete_by_id(log, gone)


# --- incremental --------------------------------------------------------------------------
_OLD_HASH = "case when doc_id % 3 = 0 then sha256(text || '!') else sha256(text) end"


@query("reembed_plan", f"""
with old as (select doc_id, {_OLD_HASH} as h, case when doc_id % 5 = 0 then 'other' else 'm1' end as model from documents where doc_id % 2 = 0)
select d.doc_id as id, sha256(text) as content_hash from documents d left join old on old.doc_id = d.doc_id and old.h = sha256(text) and old.model = 'm1' where old.doc_id is null""")
def reembed_plan(spark, d):
    """Even documents have an old vector; some with another text or another model."""
    docs = c.table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    now = docs.select("id", content_hash(F.col("text")).alias("content_hash"))
    old = docs.where("id % 2 = 0").select(
        "id",
        content_hash(F.expr("if(id % 3 = 0, text || '!', text)")).alias("content_hash"),
        F.expr("if(id % 5 = 0, 'other', 'm1')").alias("model"))
    return ingest.reembed_plan(now, old, "m1")


@query("vector_upsert", """
select doc_id as id, case when doc_id % 3 = 0 then 'new' else 'old' end as content_hash from documents""")
def vector_upsert(spark, d):
    docs = c.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    old = docs.where("id % 3 <> 0 or id % 2 = 0").withColumn("content_hash", F.lit("old"))
    new = docs.where("id % 3 = 0").withColumn("content_hash", F.lit("new"))
    return ingest.upsert_by_id(old, new)


@query("vector_upsert_keyed", """
select doc_id as id, case when doc_id % 3 = 0 then 'new' else 'old' end as content_hash from documents where doc_id % 7 <> 5""")
def vector_upsert_keyed(spark, d):
    """The same in a stored table: only the folders of changed keys are rewritten; a seventh is deleted again."""
    docs = c.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    stored = KeyedTable(spark, scratch_dir(spark), "id bigint, content_hash string", partitions=8)
    stored.upsert(docs.where("id % 3 <> 0 or id % 2 = 0").withColumn("content_hash", F.lit("old")))
    stored.upsert(docs.where("id % 3 = 0").withColumn("content_hash", F.lit("new")))
    stored.delete(docs.where("id % 7 = 5"))
    return stored.rows()


# --- streams ------------------------------------------------------------------------------
@query("stream_event_windows", """
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n_events, round(sum(value), 4) as sum_value from events group by 1, 2""")
def stream_event_windows(spark, d):
    """Update mode: a batch writes the windows that it changed, the newest row of a window counts.

    Windows older than the watermark leave the state, so that it does not grow with the stream.
    """
    events = c.stream(spark, d, "events")
    path = scratch_dir(spark)
    out = os.path.join(path, "windows")
    running = (
        jobs.event_windows(events).writeStream.outputMode("update")
        .foreachBatch(lambda frame, n: frame.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        .option("checkpointLocation", os.path.join(path, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    newest = jobs.newest_windows(spark.read.parquet(out))
    return newest.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
        "n_events", F.round("sum_value", 4).alias("sum_value"))


@query("stream_ingest_rows", """
select min(doc_id) as id from documents where len(trim(text, E' \\t\\n\\r')) >= 30
  and regexp_matches(text, '(?i)(^|[^a-z0-9])(the|of|and|der|und|la|et|que|in|is|be|was|a|this|that|r|n)($|[^a-z0-9])') group by text""")
def stream_ingest_rows(spark, d):
    """The rows of the stream below: the smallest id of each text stays."""
    return _ingested(spark, d).select("id")


@query("stream_ingest", """
select count(distinct text) as n_texts from documents where len(trim(text, E' \\t\\n\\r')) >= 30
  and regexp_matches(text, '(?i)(^|[^a-z0-9])(the|of|and|der|und|la|et|que|in|is|be|was|a|this|that|r|n)($|[^a-z0-9])')""")
def stream_ingest(spark, d):
    """Documents arrive as a stream; profiles with new content are kept."""
    return _ingested(spark, d).agg(F.count(F.lit(1)).alias("n_texts"))


def _ingested(spark, d):
    texts = c.stream(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    path = scratch_dir(spark)
    jobs.ingest_stream(
        texts, f"{path}/out", f"{path}/checkpoint", c.PROSE,
        embedding.hash_embedder(c.PROSE, digest="md5"),
    ).awaitTermination()
    return spark.read.parquet(f"{path}/out/profiles")
