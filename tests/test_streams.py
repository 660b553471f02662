"""Streams over tables that are one file or a folder of files."""

from registered import common, logs


def test_one_file_or_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"the text number {i % 7} is long enough to be kept here") for i in range(20)], "doc_id long, text string")
    folder, single = tmp_path / "folder", tmp_path / "single"
    rows.repartition(3).write.parquet(str(folder / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    single.mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(single / "documents.parquet")
    for place in (folder, single):
        assert common.stream(spark, str(place), "documents").isStreaming
        assert sorted(r.id for r in logs.stream_ingest_rows(spark, str(place)).collect()) == list(range(7))
        assert logs.stream_ingest(spark, f"file://{place}").first().n_texts == 7


def test_texts_are_staged_once_and_rows_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Same profiles whether the rows to leave out are sent or not; the staged rows hold a text once."""
    from rankspark.operators.embedding import hash_embedder
    from rankspark.plans.ingest import parse_profiles
    from rankspark.streaming import jobs

    kind = "id long, text string"
    texts = [(k, f" the engineer number {k % 7} is at Acme Freight and wrote a text that is long enough\nof r \n") for k in range(20)]
    texts += [(3, texts[3][1]), (20, "short"), (21, None), (22, "no known word stands here, is it not long enough")]
    spark.createDataFrame(texts, kind).repartition(3).write.parquet(str(tmp_path / "in"))
    want = parse_profiles(spark.createDataFrame(texts, kind), common.PROSE).where("reject_reason is null and id < 7").distinct()
    found = []
    for name, most in (("sent", jobs.SENT_NUMBERS), ("shuffled", 0)):
        monkeypatch.setattr(jobs, "SENT_NUMBERS", most)
        out = tmp_path / name
        jobs.ingest_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(out), str(tmp_path / f"{name}_check"),
                           common.PROSE, hash_embedder(common.PROSE, digest="md5")).awaitTermination()
        assert not {"text", "embedding_text"} & set(spark.read.parquet(str(out / "parsed")).columns)
        found.append(spark.read.parquet(str(out / "profiles")).drop("batch"))
    columns = [c for c in want.columns if c != "reject_reason"]
    assert found[0].columns == columns
    rows = [sorted(f.select(*columns).collect(), key=lambda r: r.id) for f in (*found, want)]
    assert rows[0] == rows[1]
    # the row with id 22 has a known word as well
    assert [r for r in rows[0] if r.id < 7] == rows[2] and len(rows[2]) == 7
