"""Repeated passages against every window counted."""

import hashlib
from collections import Counter

import numpy as np
from helpers import documents, invented, odd_documents, seeded

from rankspark.llm import suffixes

WIDTH = suffixes.WIDTH


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k: k + WIDTH] for _, b in raw for k in range(len(b) - WIDTH + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - WIDTH + 1):
            if seen[b[k: k + WIDTH]] > 1:
                gone[k: k + WIDTH] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i or 0, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


def corpus():
    rng, passages = seeded(2), []
    passages = [invented(rng, 90) for _ in range(5)]
    rows = []
    for k in range(60):
        parts = [invented(rng, rng.randint(3, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            parts.insert(rng.randrange(len(parts)), p[a: a + rng.randint(150, 420)])
        rows.append((k, "\n".join(parts)))
    rows += [(100, "Of " * 90), (101, "ab" * 400), (102, "é" * 150), (103, rows[3][1]), (104, invented(rng, 20) * 9)]
    return rows


def test_all_windows_with_shards_split(spark):
    """Tiny shards and a low bound for hot names send windows through the merge as well."""
    rows = corpus()
    docs = documents(spark, rows).repartition(3)
    want = brute(rows)
    assert got(suffixes.without_repeats(docs, shard_bytes=3000, hot=2)) == want
    assert got(suffixes.without_repeats(docs)) == want


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (None, "z" * 210), (6, "q" * 100), (7, "p" + "k" * 5)]
    assert got(suffixes.without_repeats(odd_documents(spark, rows))) == brute(rows)
    twice = [(9, invented(seeded(), 60)), (9, invented(seeded(), 60))]
    assert got(suffixes.without_repeats(documents(spark, twice))) == brute(twice)
    assert suffixes.without_repeats(documents(spark, [])).count() == 0


def test_long_texts_are_looked_at_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rng = seeded(4)
    text = invented(rng, 500)
    assert [r[0] for r in suffixes.runs(text.encode())][0] == 0
    covered = sum(r[1] for r in suffixes.runs(text.encode()))
    assert covered == len(text.encode()) - WIDTH + 1


def test_suffix_order_and_common_prefixes():
    rng = seeded(7)
    for turn in range(60):
        text = bytes(rng.choice(b"ab" if turn % 2 else b"abcdef") for _ in range(rng.randint(1, 300)))
        if turn % 3 == 0:
            text = (text[: rng.randint(1, 40)] * 60)[: rng.randint(1, 500)]
        raw = np.frombuffer(text, np.uint8)
        order = suffixes.suffix_order(raw)
        assert sorted(order) == list(range(len(text)))
        cut = [text[i: i + WIDTH] for i in order]
        assert cut == sorted(cut)
        common = suffixes.common_prefixes(raw, order)
        for k in range(1, len(order)):
            a, b = text[order[k - 1]:], text[order[k]:]
            assert common[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
