"""Values at a rounding half: SQL's answer, whatever the last bit of a double says."""

from pyspark.sql import functions as F

from rankspark.functions.text import round_half
from rankspark.operators import metrics, rerank


def test_a_fit_at_a_half_is_rounded_up(spark):
    row = spark.createDataFrame([(25.3, None, 16.0)], "y double, lo double, hi double")
    fit = rerank.years_fit(F.col("y"), F.col("lo"), F.col("hi"))
    assert row.select(round_half(fit, 4)).first()[0] == 0.4188
    rows = spark.createDataFrame([(0.123456,), (None,), (0.0,), (1.0,)], "v double").select(round_half(F.col("v"), 4))
    assert [r[0] for r in rows.collect()] == [0.1235, None, 0.0, 1.0]


def test_a_mean_at_a_half_is_rounded_up(spark):
    """The exact mean is 0.62075; summed as doubles in this order it lies below that."""
    values = (0.5789, 0.7523, 0.4412, 0.8979, 0.9977, 0.0094, 0.6287, 0.8397, 0.2118, 0.8499)
    for order in (values, values[::-1], sorted(values)):
        rows = [("s", q, v, v, v, v) for q, v in enumerate(order)]
        frame = spark.createDataFrame(rows, "strategy string, query_id int, precision_at_k double, recall_at_k double, mrr double, ndcg_at_k double").coalesce(1)
        assert {r.value for r in metrics.compare_strategies(frame).collect()} == {0.6208}


def test_years_are_rounded_as_in_sql(spark, tmp_path):
    """Balances with a tail, as sums of doubles have: years a hair beside a half, -0.0, infinity."""
    import math

    import duckdb
    from registered import profiles

    balances = [math.nextafter(12.5 * (2 * k + 1), way) for k in range(400) for way in (0.0, 1e9)]
    balances += [-0.0, 0.0, -1.0, math.inf, math.nan, 12.5, 37.5]
    rows = [(12 * n + k, "n", 0, b, "s") for n, b in enumerate(balances) for k in range(12)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(
        str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "a", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    con = duckdb.connect()
    for name in ("customer", "nation", "region"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(f"select id, fit::varchar, note from ({profiles.ORACLES['years_fit']})").fetchall()
    got = [(r.id, str(r.fit), r.note) for r in profiles.years_fit(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
