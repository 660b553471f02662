"""Each stage on planted documents, and the whole run."""

import corpus_pipeline
from helpers import documents, invented, seeded

TABLES = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}


def test_stages_and_run(spark, tmp_path):
    rng = seeded(11)
    rows = [(k, invented(rng, 60) + (" rotten filthy" if k % 5 == 0 else "")) for k in range(300)]
    item = invented(rng, 30)
    copy = rows[7][1].split()
    copy[30] = "changed"
    rows += [(900, rows[6][1]), (901, " ".join(copy)), (902, invented(rng, 20) + " " + item), (903, "key: password=hunter2abcd and more"), (904, ""), (905, None)]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], TABLES["labels"]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], TABLES["benchmark"]).write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, folder = dict(corpus_pipeline.STAGES), str(tmp_path)
    assert list(stage) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]

    out = stage["toxicity"](spark, docs, folder)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and ids == {i for i, _ in rows if i >= 900 or i % 5}
    out = stage["near_duplicates"](spark, docs, folder)
    assert out.columns == docs.columns and {i for i, _ in rows} - {r.doc_id for r in out.collect()} == {900, 901}
    out = stage["decontamination"](spark, docs, folder)
    assert out.columns == docs.columns and {i for i, _ in rows} - {r.doc_id for r in out.collect()} == {902}
    out = {r.doc_id: r for r in stage["secrets"](spark, docs, folder).collect()}
    assert len(out) == len(rows) and out[903].text == "key: [secret] and more" and out[3].text == rows[3][1]
    packed = corpus_pipeline.run(spark, folder)
    want = {i for i, _ in rows if (i >= 900 or i % 5) and i not in (900, 901, 902)}
    assert {r.doc_id for r in packed.collect()} == want
