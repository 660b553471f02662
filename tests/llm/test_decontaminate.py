"""Greedy string tiling against a plain version, and planted test items."""

import time

from helpers import documents, invented, odd_documents, seeded

from rankspark.llm import decontaminate as d

ITEMS = "item_id long, text string"


def plain_tiles(item, doc, least):
    """Longest common run of unmarked words, again and again."""
    used_i, used_d, total = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not used_i[i + n] and not used_d[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(total)
        for k in range(n):
            used_i[i + k] = used_d[j + k] = True
        total.append(n)


def test_tiles():
    rng = seeded(3)
    for turn in range(60):
        kinds = "ab" if turn % 4 == 0 else "abcdefgh"
        item = [rng.choice(kinds) for _ in range(rng.randint(1, 25))]
        doc = [rng.choice(kinds) for _ in range(rng.randint(0, 30))]
        for _ in range(2):
            a = rng.randrange(len(item))
            doc[len(doc) // 2: len(doc) // 2] = item[a: a + 9]
        got = d.tile(d.words(" ".join(item)), d.words(" ".join(doc)), 3)
        assert max([n for _, _, n in got], default=0) == max(plain_tiles(item, doc, 3), default=0)
        taken_i, taken_d = [], []
        for i, j, n in got:
            assert item[i: i + n] == doc[j: j + n] and n >= 3
            taken_i += range(i, i + n)
            taken_d += range(j, j + n)
        assert len(set(taken_i)) == len(taken_i) and len(set(taken_d)) == len(taken_d)
        if turn % 4:
            assert sum(n for _, _, n in got) == sum(plain_tiles(item, doc, 3))


def plain_candidates(items, doc, coverage):
    """Items with enough words under seeds of the document, one item after the other."""
    found = []
    for k, (_, item) in enumerate(items.items):
        size = min(items.seed, len(item))
        mine = set(d.seeds(doc, size).tolist()) if len(doc) >= size else set()
        under = {at + step for at, h in enumerate(d.seeds(item, size).tolist()) if h in mine for step in range(size)}
        if under and len(under) >= coverage * len(item):
            found.append(k)
    return found


def test_candidates():
    rng = seeded(7)
    for turn in range(80):
        kinds = "abc" if turn % 2 else "abcdefghij"
        some = lambda n: " ".join(rng.choice(kinds) for _ in range(n))
        items = d.Items([(k, some(rng.randint(0, 20))) for k in range(12)], 3)
        doc = d.words(some(rng.randint(0, 40)))
        for coverage in (0.2, 0.5, 1.0):
            assert sorted(items.candidates(doc, coverage)) == plain_candidates(items, doc, coverage)


def test_many_items_with_one_opening():
    rng = seeded(8)
    opening = invented(rng, 10)
    items = d.Items([(k, f"{opening} {invented(rng, 30)}") for k in range(16_000)])
    text = f"{invented(rng, 200)} {opening} {invented(rng, 60)} {' '.join(['the same words again'] * 10)}"
    start = time.perf_counter()
    for _ in range(10):
        assert d.leaks_of(text, items) == []
    assert time.perf_counter() - start < 3  # a tenth of a second each, with room; by items it took ten seconds each


def test_planted_items(spark):
    rng = seeded(5)
    items = [(k, invented(rng, 40)) for k in range(12)] + [(50, "tiny one"), (51, None), (52, "..."), (53, ""), (None, invented(rng, 20))]
    w = items[2][1].split()
    rows = [(k, invented(rng, 120)) for k in range(30)]
    rows += [(100, f"x y {items[0][1]} z"), (101, items[1][1].upper().replace(" ", ", ")),
             (102, " ".join(w[25:] + ["q"] + w[:12] + ["r"] + w[12:25])), (103, "before tiny, ONE after"), (104, None), (105, ""),
             (106, "p " * 30_000 + items[3][1]), (107, " ".join(items[4][1].split()[:8])), (None, items[5][1]), (108, items[-1][1]),
             (100, f"x y {items[0][1]} z")]
    want = sorted([(100, 0), (100, 0), (101, 1), (102, 2), (103, 50), (106, 3), (-1, 5), (108, -1)])
    bench = spark.createDataFrame(items, ITEMS)
    docs = odd_documents(spark, rows)
    for block in (d.BLOCK_CHARS, 300):
        got = d.leaks(docs, bench, block_chars=block).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.item_id is None else r.item_id) for r in got) == want
        kept = d.without_leaks(docs, bench, block_chars=block)
        assert kept.columns == docs.columns and kept.count() == len(rows) - len(want)
    assert [r.tiles for r in got if r.doc_id == 102] == [3]
    assert d.leaks(documents(spark, []), bench).count() == 0
    assert d.leaks(docs, spark.createDataFrame([], ITEMS)).count() == 0
