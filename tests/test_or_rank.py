"""Term ranking over classes of documents and queries, against counting by hand."""

import random

from rankspark.operators import lexical


def test_ranks_and_work_of_repeated_documents(spark, monkeypatch):
    rng = random.Random(5)
    words = ["a", "b", "c", "d", "e", "z"]
    docs = [(i, [rng.choice(words) for _ in range(rng.randint(0, 4))]) for i in range(300)] + [(900, None)]
    queries = [(q, rng.sample(["a", "b", "c", "d", "none"], rng.randint(0, 4))) for q in range(40)] + [(50, None)]
    want = {}
    for q, terms in queries:
        scored = sorted((-sum(t in terms for t in tokens), i) for i, tokens in docs if tokens and terms and set(tokens) & set(terms))
        for rank, (score, i) in enumerate(scored[:7], 1):
            tokens = dict(docs)[i]
            want[q, rank] = (i, round(-score * 0.1, 6), [t for t in terms if t in tokens])
    sides = []
    join = lexical.lookup_join
    monkeypatch.setattr(lexical, "lookup_join", lambda big, small, *rest, **more: sides.append((big, small)) or join(big, small, *rest, **more))
    got = lexical.or_rank(spark.createDataFrame(queries, "query_id long, terms array<string>"), spark.createDataFrame(docs, "id long, tokens array<string>"), 7)
    assert {(r.query_id, r.rank): (r.id, r.score, r.matched_terms) for r in got.collect()} == want
    classes, leaders = sides[-1]
    assert classes.select("class_id").distinct().count() < 110 and leaders.select("leader").distinct().count() <= 16
