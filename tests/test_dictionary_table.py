"""Skills by a table of forms: the mentions of the fold over a literal, and tables beyond its bound."""

import random

from pyspark.sql import functions as F

from rankspark.functions.dictionary import MAX_FORMS, Skill, SkillDictionary, extract_by_table, extract_skills

ODD = SkillDictionary((
    Skill("react", None, ("react native", "react.js")), Skill("react native app", None, ()), Skill("c++", None, ("c++ developer",)),
    Skill("c", None, ("c",)), Skill("c#", None, (".net core",)), Skill("one two three four", None, ("one two three five",)),
    Skill("shared", None, ("both",)), Skill("other", None, ("both", "(odd) [form]")), Skill("a  b", None, ())))
PIECES = ["react", "native", "app", "React.JS", "c++", "C", "c#", ".net", "core", "one", "two", "three", "four", "five", "both", "(odd)",
          "[form]", "a", "b", "developer", "xreact", "é", "İ", "K", "\n", "\t", "", "-", "shared"]


def test_same_mentions(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "  ", "\n", ""]).join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "react"), (902, "c++"), (None, "no match here")]
    texts = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "id long, text string, gram string, rank string")
    for cap in (2, 40):
        got = extract_by_table(texts, ODD.form_frame(spark), cap).select("id", "text", "mentions")
        want = texts.select("id", "text", extract_skills(F.col("text"), ODD, cap).alias("mentions"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_many_forms(spark):
    """Ten times as many forms as a literal may hold; the plan holds none of them."""
    many = MAX_FORMS * 10
    forms = spark.range(many).select(
        F.concat(F.lit("skill number "), F.col("id").cast("string")).alias("form"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("canonical"), F.col("id").cast("int").alias("ord"))
    texts = spark.createDataFrame([(1, "has Skill  number 7, skill number 199999 and skill number 200000"), (2, "skill number")], "id long, text string")
    found = extract_by_table(texts, forms)
    assert {r.id: [m.canonical for m in r.mentions] for r in found.collect()} == {1: ["s199999", "s7"], 2: []}
    assert "skill number 7" not in found._jdf.queryExecution().toString()


def test_no_forms(spark):
    texts = spark.createDataFrame([(1, "anything")], "id long, text string")
    empty = spark.createDataFrame([], "form string, canonical string, ord int")
    assert extract_by_table(texts, empty).first()["mentions"] == []


def test_grams_are_never_broadcast(spark, tmp_path):
    """Texts whose files look small to the planner beside forms whose size it does not know."""
    spark.range(50).selectExpr("id", "'react native and both' as text").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    found = extract_by_table(texts, ODD.form_frame(spark))
    assert {tuple(m.canonical for m in r.mentions) for r in found.collect()} == {("react", "shared")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [gram" in plan and "BuildRight" in plan and "BuildLeft" not in plan and "hashpartitioning(gram" not in plan
    many = spark.range(60_000).selectExpr("concat('react', id) as form", "'x' as canonical", "cast(id as int) as ord")
    plan = extract_by_table(texts, many)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
