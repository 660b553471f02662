"""Grades of documents by sentences of passages: each sentence counts once, documents are not shuffled whole."""

from registered.searches import passage_grades


def test_sentences_count_once_and_only_those_met_are_gathered(spark, tmp_path):
    passages = [(1, "one long sentence here. another long sentence"), (2, "one long sentence here")]
    docs = [(10, "one long sentence here.one long sentence here."), (11, "another long sentence\none long sentence here"),
            (12, "nothing that anybody has asked for"), (13, None)]
    spark.createDataFrame(passages, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grades = passage_grades(spark, str(tmp_path))
    want = {(1, 10): 1, (2, 10): 1, (1, 11): 1, (2, 11): 1}
    # the second sentence of passage 1 starts with a blank, so it is another one than that of document 11
    assert {(r["query_id"], r["id"]): r["grade"] for r in grades.collect()} == want
    plan = grades._jdf.queryExecution().sparkPlan().toString()
    documents = plan[plan.index("BroadcastHashJoin"):].split("FileScan")[0]
    assert "Aggregate" not in documents  # a distinct of all their sentences would shuffle the texts
