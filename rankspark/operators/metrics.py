"""Ranking quality: precision, recall, reciprocal rank, nDCG, and strategy comparison.

    ranking   query_id, id, rank [, strategy]
    grades    query_id, id, grade         (grade > 0 is relevant)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("precision_at_k", "recall_at_k", "mrr", "ndcg_at_k")


def gain(grade: Column, position: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(position + 1)


def ideal_gains(grades: DataFrame, k: int) -> DataFrame:
    """(query_id, total_relevant, ideal_dcg) over all graded rows of a query.

    Counted per grade first: what reaches one group is one row per distinct grade, however
    many rows of the pool are relevant to a query.
    """
    counts = grades.groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("grade", "n")), asc=False)
    best = F.slice(
        F.flatten(
            F.transform(
                "ordered",
                lambda g: F.array_repeat(g["grade"], F.least(g["n"], F.lit(k)).cast("int")),
            )
        ),
        1,
        max(k, 0),
    )
    gains = F.transform(best, lambda g, i: gain(g, i + 1))
    return (
        counts.groupBy("query_id")
        .agg(
            F.sum(F.when(F.col("grade") > 0, F.col("n")).otherwise(0)).alias("total_relevant"),
            ordered.alias("ordered"),
        )
        .select(
            "query_id", "total_relevant",
            F.aggregate(gains, F.lit(0.0), lambda s, v: s + v).alias("ideal_dcg"),
        )
    )


def evaluate_rankings(
    ranking: DataFrame,
    grades: DataFrame,
    k: int = 10,
    queries: DataFrame | None = None,
    strategies: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (strategy, query) with the four metrics rounded to four digits.

    ``queries`` (query_id) and ``strategies`` add the rankings that came back empty; their
    metrics are 0.  Reciprocal rank looks at the whole list, the others at its first k.
    """
    by = ["strategy", "query_id"] if "strategy" in ranking.columns else ["query_id"]
    relevant = (F.col("grade") > 0) & (F.col("rank") <= k)
    scored = (
        ranking.select(*by, "id", "rank")
        .join(grades.where(F.col("grade") > 0), ["query_id", "id"])
        .groupBy(*by)
        .agg(
            F.count_if(relevant).alias("hits"),
            F.min("rank").alias("first_rank"),
            F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))).alias("dcg"),
        )
    )
    if queries is not None:
        base = queries.select("query_id")
        if "strategy" in by:
            base = base.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    else:
        base = ranking.select(*by).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    c = F.col
    precision = zero(c("hits") / k) if k > 0 else F.lit(0.0)
    return (
        base.join(scored, by, "left")
        .join(ideal_gains(grades, k), "query_id", "left")
        .select(
            *by,
            F.round(precision, 4).alias("precision_at_k"),
            F.round(
                zero(F.when(c("total_relevant") > 0, c("hits") / c("total_relevant"))), 4
            ).alias("recall_at_k"),
            F.round(zero(1 / c("first_rank")), 4).alias("mrr"),
            F.round(zero(F.when(c("ideal_dcg") > 0, c("dcg") / c("ideal_dcg"))), 4).alias(
                "ndcg_at_k"
            ),
            F.coalesce("total_relevant", F.lit(0)).alias("total_relevant"),
        )
    )


def compare_strategies(per_query: DataFrame) -> DataFrame:
    """(strategy, metric, value, is_best): means over queries, and the best value per metric.

    The metrics have four digits, so their sums are exact in units of the last one: a mean at a rounding
    half is rounded up whatever the order of the rows.
    """
    def mean(metric: str) -> Column:
        units = F.sum(F.round(F.col(metric) * 10_000).cast("bigint"))
        return F.floor((2 * units + F.count(metric)) / (2 * F.count(metric))) / F.lit(10_000.0)

    means = per_query.groupBy("strategy").agg(*[mean(m).alias(m) for m in METRICS])
    long = means.unpivot("strategy", list(METRICS), "metric", "value")
    best = F.max("value").over(Window.partitionBy("metric"))
    return long.withColumn("is_best", F.col("value") == best)


def top_results(ranking: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """Per-query report: ids and grades of the first k results, in order."""
    by = ["strategy", "query_id"] if "strategy" in ranking.columns else ["query_id"]
    graded = ranking.where(F.col("rank") <= k).join(grades, ["query_id", "id"], "left")
    row = F.struct("rank", "id", F.coalesce("grade", F.lit(0)).alias("grade"))
    listed = graded.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("top"))
    return listed.select(*by, F.col("top.id").alias("top_ids"), F.col("top.grade").alias("top_grades"))


def grade_by_rules(facts: DataFrame, rules: Sequence[tuple[object, Column, Column]]) -> DataFrame:
    """(query_id, id, grade) from rules (query_id, ideal, acceptable) over facts; grade > 0 only.

    All rules are evaluated in the row, so the facts are read once and never paired with queries.
    """
    graded = F.array(
        *[
            F.struct(
                F.lit(q).alias("query_id"),
                F.when(ideal, 2).when(acceptable, 1).otherwise(0).alias("grade"),
            )
            for q, ideal, acceptable in rules
        ]
    )
    positive = F.filter(graded, lambda g: g["grade"] > 0)
    return facts.select("id", F.inline(positive)).select("query_id", "id", "grade")
