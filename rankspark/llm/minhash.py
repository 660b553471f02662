"""Near-duplicate detection by HyperMinHash.

A document's set of word shingles is hashed once.  The hash's bucket picks one of ``BUCKETS`` registers;
a register keeps, of the smallest remaining value, the count of leading zeros and ``MANTISSA`` bits
after them (16 bits in all).  Registers without a value borrow from another by a fixed random order
that is the same for all documents, so that short documents can be compared too and two registers
agree with the probability of the sets' similarity.

1. Documents with equal sets form a class (minimum doc_id by set digest, combined before the shuffle).
2. Registers of class representatives are cut into bands, as long as the threshold lets them be
   (``rows_of_a_band``).  Representatives that share a band are not paired with each other but with the
   band's most central one, which shares most bands with others: as many pairs as rows.
3. A pair's similarity is estimated from the share of equal registers, corrected for registers that are
   equal by chance; pairs more than ``SIGMAS`` standard errors under the threshold are no links.
4. What is left is confirmed on the full shingle sets.  A second round does the same with those that the
   centre of their band does not link.
5. Two members x, y of the star of a centre p can still be linked unseen if p does not link y.  They then
   either share shingles that p lacks, and are found by a join on the first of those (a prefix filter, the
   rarest of the star first, with what can follow bounded by the places), or share only shingles of p,
   which bounds the size of x by that of y's part in p, and are found by a join on size classes.  Pairs that a component already has are left out; the others go through 3 and 4.
6. Links make components; a class follows its representative.

Similarity is compared as integers: 100 * intersection >= percent * union.

Edge cases: a null or empty text, or one of white space alone, has an empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; a row with a null doc_id has component
and kept null and takes part in no link; rows of one doc_id are rows of one document, each with its
own set, and reach what any of them reaches; an empty table gives no rows; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import each_text, staged, texts_of
from rankspark.llm.components import components

BUCKETS, MANTISSA = 320, 10
MISSED = 1e-5            # most of the pairs at the threshold that may share no band
SIGMAS = 7.5
SALTS = 16               # parts that the members of one star are dealt over
WORDS, PERCENT = 3, 85
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values, well spread."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    parts = text.encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space alone
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(h))
    total = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        total = (total + h[k: k + len(total)]) * _MIX[(k + size) % 5]
        total ^= total >> np.uint64(29)
    return np.unique(mixed(total + np.uint64(size)))


_ORDER = np.random.default_rng(17).permuted(np.tile(np.arange(BUCKETS, dtype=np.uint16), (BUCKETS, 1)), axis=1)


def registers(found: np.ndarray) -> np.ndarray:
    """The compressed registers of a set, all filled; a set without members has zeros."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(found):
        return out
    bucket = ((found >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    value = mixed(found + _MIX[0]) >> np.uint64(11)                     # 53 bits, exact as floats
    keyed = np.sort((bucket << np.uint64(53)) | value)
    bucket = (keyed >> np.uint64(53)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    part, exponent = np.frexp(np.maximum(keyed[first] & np.uint64((1 << 53) - 1), np.uint64(1)).astype(float))
    zeros = 54 - exponent                                               # leading zeros and one: never 0
    out[bucket[first]] = (zeros << MANTISSA) + ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    empty = np.flatnonzero(out == 0)
    if len(empty):
        filled = bucket[first]
        out[empty] = out[filled[_ORDER[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def rows_of_a_band(percent: int) -> int:
    """The most registers in a band that leave at most MISSED of the pairs at the threshold unmet."""
    share = percent / 100
    return max((r for r in range(1, BUCKETS + 1) if (1 - share ** r) ** (BUCKETS // r) <= MISSED), default=1)


def bands(filled: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` registers."""
    n = BUCKETS // rows
    cells = np.zeros((n, -(-rows // 4) * 4), np.uint16)
    cells[:, :rows] = filled[: n * rows].reshape(n, rows)
    total = np.arange(1, n + 1, dtype=np.uint64) * _MIX[4]
    for column in cells.view(np.uint64).T:
        total = mixed((total + column) * _MIX[3])
    return total.view(np.int64)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of these sizes agree."""
    zeros = np.arange(0, 54)[:, None]
    high, low = 2.0 ** -zeros, 2.0 ** -(zeros + 1)                      # the smallest value lies between

    def share(n: np.ndarray) -> np.ndarray:
        load = np.maximum(n / BUCKETS, 1.0)
        return np.exp(-load * low) - np.exp(-load * high)

    return (share(n_a) * share(n_b)).sum(axis=0) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity by rows of registers (rows x BUCKETS), corrected for chance agreement."""
    c = chance(n_a, n_b)
    return np.clip(((a == b).mean(axis=1) - c) / (1 - c), 0, 1)


def slack(n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """SIGMAS standard errors of the estimate near the threshold; short sets have fewer independent registers."""
    seen = np.minimum(np.minimum(n_a, n_b), BUCKETS)
    return SIGMAS * np.sqrt(threshold * (1 - threshold) / np.maximum(seen, 1))


def sketches(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest (low, high), bands and registers of every row."""
    rows = rows_of_a_band(percent)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in each_text(batches):
            sets = [shingles(t, words) for t in texts]
            filled = [registers(s) for s in sets]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            keyed = [bands(f, rows) if len(s) else None for s, f in zip(sets, filled)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(keys, pa.int64()), "n_shingles": pa.array(map(len, sets), pa.int64()),
                "low": pa.array(digests[:, 0]), "high": pa.array(digests[:, 1]),
                "bands": pa.array(keyed, pa.list_(pa.int64())),
                "registers": pa.array([f.astype("<u2").tobytes() for f in filled], pa.binary())})

    return texts_of(docs).mapInArrow(
        make, "doc_id long, n_shingles long, low long, high long, bands array<long>, registers binary")


def shingle_sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and its full set of shingle hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in each_text(batches):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(keys, pa.int64()),
                "members": pa.array([shingles(t, words).view(np.int64) for t in found], pa.list_(pa.int64()))})

    return texts.mapInArrow(make, "doc_id long, members array<long>")


def estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``bound``, the most their similarity may be, and whether that reaches the threshold."""
    side = (lambda n: reps.select(F.col("doc_id").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("registers").alias(f"r_{n}")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [np.frombuffer(b"".join(p[c]), "<u2").reshape(-1, BUCKETS) for c in ("r_a", "r_b")]
            n_a, n_b = p["n_a"].to_numpy(float), p["n_b"].to_numpy(float)
            bound = np.minimum(estimate(*rows, n_a, n_b) + slack(n_a, n_b, percent / 100), 1.0)
            bound = np.minimum(bound, np.minimum(n_a, n_b) / np.maximum(n_a, n_b))  # sizes bound it as well
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "bound": bound})

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.mapInPandas(judge, "a long, b long, bound double")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs (a, b) with their sizes, common shingles, ``linked``, and ``extra``: a's shingles that b lacks."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = staged(shingle_sets(texts.join(ids, texts["doc_id"] == ids["id"], "left_semi"), words))
    side = (lambda n: sets.select(F.col("doc_id").alias(n), F.col("members").alias(f"m_{n}")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", F.size("m_a").cast("long").alias("n_a"), F.size("m_b").cast("long").alias("n_b"),
                       F.array_except("m_a", "m_b").alias("extra"))
    both = both.withColumn("common", F.col("n_a") - F.size("extra"))
    return both.select("a", "b", "n_a", "n_b", "common", _reaches(F.col("common"), percent).alias("linked"), "extra")


def _reaches(common, percent: int, n_a: str = "n_a", n_b: str = "n_b"):
    """Whether so many common shingles make a link."""
    return (100 + percent) * common >= percent * (F.col(n_a) + F.col(n_b))


def _stars(members: DataFrame, scores: DataFrame) -> DataFrame:
    """(a, b, many): members of bands with the most central of each band, and the size of the largest band."""
    ranked = members.join(scores, "doc_id")
    heads = staged(ranked.groupBy("band").agg(
        F.max(F.struct("score", (-F.col("doc_id")).alias("least"))).alias("top"), F.count(F.lit(1)).alias("many"))
        .filter("many > 1").select("band", (-F.col("top.least")).alias("head"), "many"))
    met = members.select("band", "doc_id").join(heads, "band").filter("doc_id <> head")
    return staged(met.groupBy(F.col("doc_id").alias("a"), F.col("head").alias("b")).agg(F.max("many").alias("many")))


def _unseen(exact: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one star that may be links though not both are linked to its centre (step 5)."""
    # a star may hold a third of all documents: its members are dealt by salt as well, and so is its centre
    odd = exact.filter(~F.col("linked")).select("b").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = exact.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    rows = salted.join(odd, ["b", "salt"], "left_semi").join(roots, salted["a"] == roots["node"], "left").select(
        "b", "a", F.col("n_a").alias("n"), "common", "linked", "extra", F.coalesce("root", "a").alias("root"))
    rows = staged(rows.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100) - F.col("common"))))
    # a link of a member shares at least ``need`` of its extra shingles, so one of the rarest of the star among them
    # stands before the last need - 1: with frequent ones last, few members meet
    each = rows.select("b", "a", F.explode("extra").alias("t"))
    often = each.groupBy("b", "t").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = each.join(often, ["b", "t"]).groupBy("b", "a").agg(F.array_sort(F.collect_list(F.struct("often", "t"))).alias("met"))
    ahead = F.greatest(F.lit(0), F.size("met") - F.col("need") + 1).cast("int")  # those that no other member has go first
    rows = rows.drop("extra").join(shared, ["b", "a"], "left").withColumn("met", F.coalesce("met", F.array().cast("array<struct<often:bigint,t:bigint>>")))
    rows = staged(rows.withColumn("prefix", F.slice("met.t", F.lit(1), ahead)).withColumn(
        "many", F.size("met").cast("long")).drop("met", "need"))
    narrow = ("a", "n", "common", "linked", "root", "many")
    # of the extra shingles only the one that a row stands for goes along into the joins
    named = (lambda side, *more: rows.select("b", *[F.col(c).alias(f"{c}_{side}") for c in narrow], *more))
    each = (lambda side: F.posexplode("prefix").alias(f"at_{side}", "t"))
    x, y = named("x"), named("y").filter(~F.col("linked_y"))
    fits = ((F.col("root_x") != F.col("root_y")) & (F.col("linked_x") | (F.col("a_x") < F.col("a_y")))
            & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")))
    most = F.least("common_x", "common_y")
    # they share shingles that the centre lacks: then the first of those in the order, and at most what stands behind it
    left = F.least(*[F.col(f"many_{s}") - F.col(f"at_{s}") for s in "xy"])
    met = named("y", each("y")).filter(~F.col("linked_y")).join(named("x", each("x")), ["b", "t"])
    by_shingle = met.filter(fits & _reaches(most + left, percent, "n_x", "n_y"))
    # or none, and what they share of the centre is enough alone
    size_class = (lambda n: F.floor(F.log(n) * 50).cast("int"))
    largest = F.floor(F.col("common_y") * (100 + percent) / percent).cast("long") - F.col("n_y")
    smallest = F.ceil(F.col("n_y") * percent / 100)
    small = y.filter(largest >= smallest).withColumn("t", F.explode(F.sequence(size_class(smallest), size_class(largest + 1))))
    by_size = small.join(x.withColumn("t", size_class(F.col("n_x"))), ["b", "t"]).filter(fits & _reaches(most, percent, "n_x", "n_y"))
    pair = (F.col("a_x").alias("a"), F.col("a_y").alias("b"))
    return staged(by_shingle.select(*pair).unionByName(by_size.select(*pair)).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    texts = texts_of(docs)
    every = staged(sketches(docs, words, percent))
    narrow = every.select("doc_id", "n_shingles", "low", "high")
    classes = staged(narrow.filter("doc_id is not null and n_shingles > 0").groupBy("low", "high")
                     .agg(F.min("doc_id").alias("rep")))
    reps = every.join(classes.select(F.col("low").alias("l"), F.col("high").alias("h"), F.col("rep")),
                      (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")) & (F.col("doc_id") == F.col("rep")), "left_semi")
    reps = staged(reps.select("doc_id", "n_shingles", "bands", "registers"))

    rows = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    members = staged(rows.join(shared, "band").select("band", "doc_id", "many"))
    scores = staged(members.groupBy("doc_id").agg(F.sum("many").alias("score")))

    def examined(pairs: DataFrame) -> DataFrame:
        """Pairs with their exact figures; those that the estimate rules out only if their band has others."""
        judged = estimated(pairs, reps, percent).join(pairs, ["a", "b"]).filter(
            (F.col("bound") * 100 >= percent - 1e-6) | (F.col("many") > 2))
        return staged(confirmed(staged(judged.select("a", "b")), texts, percent, words))

    first = examined(_stars(members, scores))
    links = first.filter("linked").select("a", "b")
    if not first.filter(~F.col("linked")).isEmpty():
        left = first.filter(~F.col("linked")).select(F.col("a").alias("doc_id")).distinct()
        second = examined(_stars(members.join(left, "doc_id", "left_semi"), scores).withColumn("many", F.lit(2)))
        links = staged(links.unionByName(second.filter("linked").select("a", "b")))
        more = examined(_unseen(first, components(links), percent).withColumn("many", F.lit(2)))
        links = links.unionByName(more.filter("linked").select("a", "b"))

    # a doc_id with several rows may be in several classes: it links their representatives
    own = narrow.filter("doc_id is not null and n_shingles > 0").join(classes, ["low", "high"]).select("doc_id", "rep")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least <> most")
    links = links.unionByName(own.join(several, "doc_id").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    links = staged(links)
    member = classes.withColumnRenamed("rep", "member")
    out = narrow.join(member, ["low", "high"], "left")
    if links.isEmpty():
        root = F.col("member")
    else:
        roots = components(links)
        out = out.join(roots, out["member"] == roots["node"], "left")
        root = F.coalesce("root", "member")
    real = F.col("doc_id").isNotNull()
    own_id = F.when(real & (F.col("n_shingles") > 0), root).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), (own_id == F.col("doc_id")).alias("kept"))
