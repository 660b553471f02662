"""Joins of a search: what only looks small in its files is not broadcast."""

from pyspark.sql import functions as F

from rankspark.functions.dictionary import Skill, SkillDictionary
from rankspark.operators.filters import FILTER_TYPE
from rankspark.operators.shape import late_join
from rankspark.plans.search import Engine, as_profiles, prepare, retrieve


def _plan(frame):
    return frame._jdf.queryExecution().sparkPlan().toString()


def test_vectors_are_not_broadcast_to_the_filters(spark, tmp_path):
    rows = [(i, f"python developer number {i}", "senior" if i % 2 else "junior") for i in range(40)]
    spark.createDataFrame(rows, "id bigint, text string, seniority string").write.parquet(f"{tmp_path}/people")
    profiles = as_profiles(spark.read.parquet(f"{tmp_path}/people"))
    queries = spark.sql(f"""select 1L as query_id, 'python' as raw_query,
      from_json('{{"seniority": ["senior"]}}', '{FILTER_TYPE}') as filters""")
    engine = Engine(SkillDictionary((Skill("python"),)))
    hits = retrieve(queries, prepare(queries, engine), profiles, engine, "vector")
    assert "BroadcastHashJoin" not in _plan(hits)
    assert sorted(r["id"] for r in hits.collect()) == list(range(1, 40, 2))


def test_late_join_sends_few_ids_and_never_the_rows(spark, tmp_path):
    spark.range(100).withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/big")
    big = spark.read.parquet(f"{tmp_path}/big")
    many = late_join(spark.range(60_000).withColumn("id", F.col("id") % 100), big, "id")
    assert "BroadcastHashJoin" not in _plan(many) and many.count() == 60_000
    few = late_join(spark.range(3).withColumn("rank", F.lit(1)), big, "id")
    assert "BuildRight" in _plan(few) and few.count() == 3
