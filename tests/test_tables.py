"""Tables of one file are spread over the cores."""

from registered import common


def test_customers_of_one_file_are_spread(spark, tmp_path):
    rows = spark.range(100).selectExpr("id as c_custkey", "'n' as c_name", "'BUILDING' as c_mktsegment")
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    texts = common.people_texts(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert sorted(r.id for r in texts.select("id").collect()) == list(range(100))
