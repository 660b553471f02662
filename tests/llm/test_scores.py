"""Quality and toxicity: held-out accuracy, contract columns and edge cases."""

import os
import zlib

import numpy as np
import pytest
from helpers import documents, invented, odd_documents, seeded

from rankspark.llm import quality, toxicity

DATA = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("module,label,parts,held,least", [(quality, "quality", 3, 1, 0.95), (toxicity, "toxic", 5, 0, 0.75)])
def test_held_out(spark, module, label, parts, held, least):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    run = module.quality if module is quality else module.toxicity
    rows = run(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    seen = [(truth[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert auc([t for t, _, _ in seen], [s for _, s, _ in seen]) >= least
    assert np.mean([t == p for t, _, p in seen]) >= 0.9


def test_held_out_labels_are_not_learnt(spark):
    """Turning the held-out labels around changes no score."""
    rng = seeded()
    rows = [(k, invented(rng, 40) + (" rotten awful" if k % 4 == 0 else "")) for k in range(240)]
    labels = [(k, 1, int(k % 4 == 0)) for k, _ in rows]
    turned = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    docs = documents(spark, rows)
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(a[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.95
    kept = {r.doc_id for r in toxicity.without_toxic(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert kept == {k for k in a if a[k] < 0.5}


@pytest.mark.parametrize("run,default", [(quality.quality, 1.0), (toxicity.toxicity, 0.0)])
def test_edge_cases(spark, run, default):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "c " * 40_000), (4, "c " * 40_000)]
    some = spark.createDataFrame([(k, None if k == 3 else k % 2, None if k == 5 else k % 2) for k in range(40)] + [(None, 1, 1)], LABELS)
    rng = seeded()
    docs = odd_documents(spark, rows + [(k, invented(rng, 9)) for k in range(5, 40)])
    out = run(docs, some).collect()
    assert len(out) == 40 and all(0 <= r.score <= 1 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [None]
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    none = run(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {default}
    assert run(documents(spark, []), some).count() == 0


def test_network_covers_the_whole_text():
    for n in (0, 1, quality.CHUNK - 4, quality.CHUNK, 5 * quality.CHUNK + 3):
        text = "".join(chr(97 + k % 26) for k in range(n))
        cut = quality.chunks(text)
        flat = np.concatenate([cut[0], *[c[quality.WIDTH - 1:] for c in cut[1:]]])
        assert bytes(flat[flat != quality.PAD].astype(np.uint8)).decode() == text


def test_gradients_match_differences():
    rng, model = np.random.default_rng(0), {k: v.astype(float) for k, v in quality.start(1).items()}
    symbols = quality.chunks("some text, " * 90)
    loss = lambda: np.log1p(np.exp(-quality.logit(model, quality._tables(model), symbols)))
    grads = quality._gradients(model, quality._tables(model), symbols, 1, 1.0)
    for name in model:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in model[name].shape)
            held, step = model[name][at], 1e-5
            model[name][at] = held + step
            up = loss()
            model[name][at] = held - step
            slope = (up - loss()) / (2 * step)
            model[name][at] = held
            assert abs(slope - grads[name][at]) < 1e-4
