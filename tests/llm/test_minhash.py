"""HyperMinHash near-duplicates against all pairs compared."""

import numpy as np
import pytest
from helpers import Sets, documents, invented, odd_documents, seeded

from rankspark.llm import minhash


def brute(rows, words=3, percent=85):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k: k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    found = Sets(sets)
    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                found.link(a, b)
    return {i: (len(sets[i]), found.root(i), found.root(i) == i) for i in ids}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_groups_of_near_copies(spark, words, percent):
    rng, rows = seeded(), []
    for group in range(4):
        base = invented(rng, 140).split()
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**9)}"
            cut = rng.choice([0, 0, 0, rng.randint(1, 25)])
            rows.append((len(rows) * 7 + 3, " ".join(copy[cut:])))
    rows += [(10_000 + k, invented(rng, rng.randint(1, 30))) for k in range(60)]
    rows += [(20_000 + k, rows[k][1]) for k in range(0, 40, 4)]  # exact copies
    rng.shuffle(rows)
    assert got(minhash.near_duplicates(documents(spark, rows).repartition(5), words, percent)) == brute(rows, words, percent)


def test_hidden_links_of_a_star(spark):
    """Members that only meet through shingles the centre lacks, or through its shingles alone."""
    rng = seeded(9)
    base = [f"b{k}" for k in range(100)]
    rows = [(k, " ".join(base)) for k in range(1, 4)]
    tail = [f"x{k}" for k in range(14)]
    for k in range(6):
        rows.append((100 + k, " ".join(base[:88] + tail + [f"t{k}"])))
        rows.append((200 + k, " ".join(base[k: 84 + k // 2])))
        rows.append((300 + k, " ".join(base[: 90] + [f"u{k}{j}" for j in range(6)])))
    rng.shuffle(rows)
    assert got(minhash.near_duplicates(documents(spark, rows))) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "a b c"), (9, "A\x0bB\x0cC"),
            (10, "long " * 30_000), (11, "É b c"), (12, "é b c")]
    out = minhash.near_duplicates(odd_documents(spark, rows))
    assert out.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(out) == brute(rows)
    extra = minhash.near_duplicates(documents(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "x y z w"), (7, "a b c")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in extra if r.doc_id != 7) == [(0, 0, None), (5, 5, True), (5, 5, True)]
    assert {r.component_id for r in extra if r.doc_id == 7} == {5}
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_estimate_is_corrected():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.85):
        errors = []
        for _ in range(20):
            n = 2000
            common = rng.integers(0, 1 << 63, int(2 * n * share / (1 + share)), dtype=np.uint64)
            rest = [rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64) for _ in range(2)]
            a, b = (minhash.registers(np.unique(np.concatenate([common, r]))) for r in rest)
            errors.append(minhash.estimate(a[None], b[None], np.array([n]), np.array([n]))[0] - share)
        assert abs(np.mean(errors)) < 0.02
    assert minhash.rows_of_a_band(85) == 8 and minhash.rows_of_a_band(80) == 6
