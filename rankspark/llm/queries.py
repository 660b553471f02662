"""Registered queries of the operators, a thin layer over them, and their SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankspark.llm import (
    centroids, decontaminate, minhash, neighbours, packing, personal_data, prefix_trie, quality, secrets, sql, suffixes, token_counts,
    token_files, toxicity)
from rankspark.llm.common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the Arrow files."""
    return token_files.token_output(read_table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return neighbours.neighbours(read_table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.secret_digest(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without passages that repeat."""
    return suffixes.without_repeats(read_table(spark, sf_dir, "documents")).drop("removed")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item that it holds, whole or in pieces."""
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return personal_data.personal_digest(read_table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after five rounds from 40 starts."""
    return centroids.cluster_digest(read_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_token_files, op3_minhash, op4_neighbours, op5_token_counts, op6_packing, op7_secrets,
    op8_toxicity, op9_suffixes, op10_decontaminate, op11_pii,
    op12_clusters, op13_prefix_trie)}
ORACLES = {
    "op3_minhash": r"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) end as s
  from texts),
classes as (select doc_id, len(s) as n, min(doc_id) over (partition by list_sort(s)) as rep, s from sets),
reps as (select doc_id, n, unnest(s) as g from classes where doc_id = rep and n > 0),
links as (
  select x.doc_id as a, y.doc_id as b from reps x join reps y on x.g = y.g and x.doc_id < y.doc_id
    and 100 * x.n >= 85 * y.n and 100 * y.n >= 85 * x.n
  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
ways as (select a, b from links union all select b, a from links),
reach as (select distinct a as node, a as root from ways union select ways.b, reach.root from reach join ways on ways.a = reach.node),
roots as (select node, min(root) as root from reach group by node)
select c.doc_id, cast(c.n as bigint) as n_shingles,
       case when c.n = 0 then c.doc_id else coalesce(r.root, c.rep) end as component_id,
       case when c.n = 0 then true else coalesce(r.root, c.rep) = c.doc_id end as kept
from classes c left join roots r on r.node = c.rep""",
    "op4_neighbours": """
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.e, c.e) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5""",
    "op11_pii": sql.PERSONAL,
    "op12_clusters": sql.CLUSTERS,
    "op13_prefix_trie": sql.TRIE,
}
