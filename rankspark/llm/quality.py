"""Quality scores by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it (``CHUNK`` bytes, overlapping by
the filter width less one, so that every window of bytes is seen exactly once).  Bytes are looked up
in a learnt embedding, learnt filters slide over them, rectified responses are max-pooled in each
chunk, and the chunks' maxima are combined - the largest and the mean over the chunks - by a
logistic layer into one probability.

All parts are trained by gradient descent (Adam), in parallel tasks over shards of a bounded,
documented sample of labelled rows (``SAMPLE``).  Training looks at whole texts; the models of the
shards, being small and of fixed size, are all kept and their mean logit is the score's.

Edge cases: a null or empty text has one chunk of padding and its score; a row with a null doc_id is
scored and its ``held_out`` is null; repeated rows give repeated results; labels other than 0 and 1 are
not used; without usable labels every score is 1; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import each_text, texts_of
from rankspark.llm.sampling import crc_remainder, training_rows, usable_labels

WIDTH, DIM, FILTERS, CHUNK = 5, 6, 16, 512
SAMPLE, MODELS = 4_000, 1
EPOCHS, RATE = 6, 0.01
PAD = 256  # the symbol before and after a text, so that the shortest has a window


def chunks(text: str) -> np.ndarray:
    """Symbols by chunk, chunks x (CHUNK + WIDTH - 1); the last is filled with padding."""
    raw = np.frombuffer(text.encode(), np.uint8)
    step = CHUNK
    n = max(1, -(-(len(raw) + WIDTH - 1) // step))
    flat = np.full(n * step + WIDTH - 1, PAD, np.int32)
    flat[WIDTH - 1: WIDTH - 1 + len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(flat, step + WIDTH - 1)[::step]


def start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {"embed": draw(0.5, PAD + 1, DIM), "filters": draw((WIDTH * DIM) ** -0.5, WIDTH * DIM, FILTERS),
            "bias": np.zeros(FILTERS, np.float32), "out": draw(0.1, 2 * FILTERS), "last": np.zeros(1, np.float32)}


def _pooled(tables: np.ndarray, bias: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Rectified maximum of each filter in each chunk.  tables: response of each symbol at each filter place."""
    response = tables[0][symbols[:, : CHUNK]]
    for place in range(1, WIDTH):
        response += tables[place][symbols[:, place: place + CHUNK]]
    return np.maximum(response.max(axis=1) + bias, 0)


def _tables(model: dict[str, np.ndarray]) -> np.ndarray:
    """WIDTH x symbols x FILTERS: an embedding times a filter's place, so a response is a sum of look-ups."""
    return np.stack([model["embed"] @ model["filters"][k * DIM: (k + 1) * DIM] for k in range(WIDTH)])


def logit(model: dict[str, np.ndarray], tables: np.ndarray, symbols: np.ndarray, at_once: int = 64) -> float:
    """The network's answer for one text, a bounded number of chunks at a time."""
    top, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
    for k in range(0, len(symbols), at_once):
        pooled = _pooled(tables, model["bias"], symbols[k: k + at_once])
        top, total = np.maximum(top, pooled.max(axis=0)), total + pooled.sum(axis=0, dtype=float)
    return float(np.concatenate([top, total / len(symbols)]) @ model["out"] + model["last"][0])


def _gradients(model: dict[str, np.ndarray], tables: np.ndarray, symbols: np.ndarray, label: int, weight: float) -> dict:
    """Gradients of the weighted log loss for one text."""
    response = tables[0][symbols[:, :CHUNK]].copy()
    for place in range(1, WIDTH):
        response += tables[place][symbols[:, place: place + CHUNK]]
    where = response.argmax(axis=1)                                   # chunks x FILTERS
    best = np.take_along_axis(response, where[:, None, :], axis=1)[:, 0] + model["bias"]
    pooled = np.maximum(best, 0)
    first = pooled.argmax(axis=0)
    joined = np.concatenate([pooled[first, np.arange(FILTERS)], pooled.mean(axis=0)])
    z = float(np.clip(joined @ model["out"] + model["last"][0], -30, 30))
    slope = weight * (1 / (1 + np.exp(-z)) - label)
    back = np.tile(slope * model["out"][FILTERS:] / len(symbols), (len(symbols), 1))
    back[first, np.arange(FILTERS)] += slope * model["out"][:FILTERS]
    back *= best > 0
    row = np.arange(len(symbols))[:, None]
    d_embed, d_filters = np.zeros_like(model["embed"]), np.zeros_like(model["filters"])
    for place in range(WIDTH):
        seen = symbols[row, where + place]                            # chunks x FILTERS
        part = slice(place * DIM, (place + 1) * DIM)
        np.add.at(d_embed, seen.ravel(), (back[..., None] * model["filters"][part].T[None]).reshape(-1, DIM))
        d_filters[part] += np.einsum("cf,cfd->df", back, model["embed"][seen])
    return {"embed": d_embed, "filters": d_filters, "bias": back.sum(axis=0), "out": slope * joined,
            "last": np.array([slope])}


def fit(texts: list[str], labels: list[int], seed: int = 0, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam over small groups of texts; rare labels weigh more, up to four times."""
    model = start(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    cut = [chunks(t) for t in texts]
    y = np.asarray(labels)
    share = max(1, min((y == 0).sum(), (y == 1).sum()))
    rare = int((y == 1).sum() < (y == 0).sum())
    weight = {rare: min(4.0, len(y) / (2 * share)), 1 - rare: 1.0}
    rng, step, group = np.random.default_rng(seed), 0, 16
    for epoch in range(epochs):
        order = rng.permutation(len(cut))
        for k in range(0, len(order), group):
            tables, total = _tables(model), None
            for i in order[k: k + group]:
                g = _gradients(model, tables, cut[i], int(y[i]), weight[int(y[i])])
                total = g if total is None else {n: total[n] + g[n] for n in g}
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for name, g in total.items():
                g = g / group + 1e-4 * model[name]
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[name] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE, models: int = MODELS) -> list[dict]:
    """One model for each shard of the sample; none without usable labels."""
    rows = training_rows(texts, labels, "quality", crc_remainder(3) != 1, sample)
    shards = max(1, min(models, usable_labels(labels, "quality", crc_remainder(3) != 1).count() // 2_000)) if models > 1 else 1
    dealt = rows.select("doc_id", "label", "text", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(shards)).alias("shard"))

    def learn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "label", "text"])
        model = fit(list(frame["text"]), list(frame["label"]), seed=int(key[0]))
        return pd.DataFrame({"shard": [key[0]], **{k: [v.astype("<f4").tobytes()] for k, v in model.items()}})

    kinds = "shard long, embed binary, filters binary, bias binary, out binary, last binary"
    parts = sorted(dealt.groupBy("shard").applyInPandas(learn, kinds).collect(), key=lambda p: p["shard"])
    shapes = {k: v.shape for k, v in start(0).items()}
    return [{k: np.frombuffer(p[k], "<f4").reshape(s) for k, s in shapes.items()} for p in parts]


def score_texts(docs: DataFrame, models: list[dict]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = [(m, _tables(m).astype(np.float32)) for m in shared.value]
        for keys, texts in each_text(batches):
            cut = (chunks(t) for t in texts)
            mean = np.array([sum(logit(m, t, c) for m, t in nets) / len(nets) if nets else np.inf for c in cut], float)
            scores = 1 / (1 + np.exp(-np.clip(mean, -700, 700))) if nets else np.ones(len(keys))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "score": pa.array(scores)})

    scored = texts_of(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (crc_remainder(3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score_texts(docs, train(texts_of(docs), labels, sample))
