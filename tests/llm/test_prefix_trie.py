"""The trie of rebuilt conversations against one built in a dictionary."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
from helpers import seeded

from rankspark.llm import prefix_trie, sql

SCHEMA = "conv_id long, turn long, role string, text string, depth long, head string, rid string, n long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in turns.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, convs in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(convs) - 1) * len(key[-1][1]) if key else 0
    return sorted((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), children[key], leaves[key], saved[key],
                   hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(key)).encode()).hexdigest())
                  for key, convs in members.items())


def got(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()))


def dialogues(rng, many, words=3, longest=14):
    rows = []
    for c in range(many):
        for t in range(rng.choice([1, 2, 3, 6, longest])):
            rows.append((c, t * 2, rng.choice(["user", "assistant"]), "w" * rng.randrange(words)))
    rows += [(10_000 + k, t, "user", f"same {t}") for k in range(60) for t in range(9)]       # many copies
    rows += [(20_000 + k, t, "user", f"same {t}" if t < 7 else f"{k} {t}") for k in range(40) for t in range(9)]
    rng.shuffle(rows)
    return rows


def test_small_blocks_and_containers(spark):
    """Blocks of a few turns and containers that burst again and again give what one large one gives."""
    rows = dialogues(seeded(4), 330)
    want = brute(rows)
    frame = made(spark, rows).repartition(5)
    assert got(prefix_trie.prefix_trie(frame)) == want
    assert got(prefix_trie.prefix_trie(frame, 4, 40)) == want


def test_one_long_conversation(spark):
    """Many turns in one conversation, spread over tasks, and another that leaves it late."""
    rows = [(7, t, "user", f"t{t % 50}") for t in range(250)] + [(8, t, "user", f"t{t % 50}") for t in range(230)] + [(8, 9000, "user", "x")]
    rows += [(7, None, "user", "first"), (8, None, "user", "first"), (100, 1, "a", "b")]
    frame = made(spark, rows).repartition(6)
    assert got(prefix_trie.prefix_trie(frame, 16, 60)) == brute(rows)


def test_pieces_of_ends(spark, monkeypatch):
    rows = [(c, 0, "user", "hello") for c in range(0, 90_000, 100)] + [(c, 0, "user", f"{c}") for c in range(5, 9000, 100)]
    monkeypatch.setattr(prefix_trie, "PIECE", 100)
    assert got(prefix_trie.prefix_trie(made(spark, rows).repartition(3))) == brute(rows)


def test_edge_cases(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 3, "user", "a"), (1, 3, "user", "a"), (1, 3, "assistant", "a"), (2, 1, "", ""),
            (3, 1, "us", "er"), (3, 2, "use", "r"), (-5, 1, "user", "minus"), (-100, 1, "user", "base"), (200, 0, "user", "x"), (217, 5, "user", "é😀"),
            (299, 0, "user", "long " * 20_000)]
    out = prefix_trie.prefix_trie(made(spark, rows))
    assert out.columns == COLUMNS and got(out) == brute(rows)
    assert got(prefix_trie.prefix_trie(made(spark, []))) == []
    assert got(prefix_trie.prefix_trie(made(spark, rows[:1]))) == []


def test_sql_agrees(spark, tmp_path):
    rows = dialogues(seeded(6), 120) + [(1, None, None, None), (200, 0, None, "é"), (None, 1, "x", "y")]
    made(spark, rows).drop("depth", "head", "rid", "n").write.parquet(str(tmp_path / "conversations"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations/*.parquet'")
    answer = con.sql(sql.TRIE)
    order = [answer.columns.index(c) for c in COLUMNS]
    assert sorted(tuple(r[k] for k in order) for r in answer.fetchall()) == brute(rows)
