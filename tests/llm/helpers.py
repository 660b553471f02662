"""Small tables and brute-force versions for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text) as a documents table."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def odd_documents(spark, rows):
    """The same with columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    out = documents(spark, rows)
    for name in ("score", "label", "value", "rep", "root", "node", "a", "b", "band", "spans", "shard"):
        out = out.withColumn(name, F.lit(None).cast("string"))
    return out


def invented(rng, n):
    parts = ["an", "er", "tion", "the", "ing", "ou", "re", "st", "bl", "ed", "is", "on"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def seeded(seed=5):
    return random.Random(seed)


class Sets:
    """Union-find with the smallest member as root."""

    def __init__(self, members):
        self.parent = {m: m for m in members}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
