"""Benchmark decontamination by greedy string tiling.

Words of test items and documents are hashed.  Seeds, runs of ``SEED`` words of an item, are looked up
in each document; items whose seeds could cover enough of them there are tiled: again and again the
longest run of words that item and document share and that no tile holds yet is found by running
Karp-Rabin hashes, checked word by word and marked, until none of ``SEED`` words is left.  The share
of the item's words under tiles decides; so the order of its parts in the document does not matter.

Test items go to the tasks in blocks of at most about ``BLOCK_CHARS`` characters, one pass over the
documents for each block, so that what is broadcast is bounded however large the benchmark is.

Edge cases: an item of fewer than ``SEED`` words must be there as a whole, one without words is found
nowhere; null and empty texts are clean; items with equal texts are all reported; a row with a null
doc_id is judged like any other, one with a null item_id too; repeated rows give repeated results; an
empty table of documents or items gives no rows; columns other than ids and texts are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import each_text, sliced, texts_of

SEED, COVERAGE = 5, 0.5
BLOCK_CHARS = 4 << 20
_BASE = 0x9E3779B97F4A7C15
#: ASCII letters and digits and the bytes of other alphabets; anything else parts words.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
KINDS = "doc_id long, item_id long, item_words int, covered_words int, tiles int, coverage double"


def words(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words of a text."""
    parts = text.lower().encode().translate(_WORD_BYTES).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


class Rolling:
    """Karp-Rabin hashes of all windows of a sequence, for any length, from one running sum."""

    def __init__(self, seq: np.ndarray):
        self.n = len(seq)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[1], np.full(self.n, _BASE, np.uint64)]).astype(np.uint64))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(seq * self.power[: self.n])])

    def windows(self, length: int, reach: int) -> np.ndarray:
        """Hash of each window, raised to the power ``reach`` so that places do not matter; needs a power table of that size."""
        n = self.n - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return (self.sums[length:] - self.sums[:n]) * _powers(reach)[reach - np.arange(n)]


_KNOWN = np.ones(1, np.uint64)


def _powers(upto: int) -> np.ndarray:
    global _KNOWN
    if len(_KNOWN) <= upto:
        with np.errstate(over="ignore"):
            _KNOWN = np.cumprod(np.concatenate([[1], np.full(2 * upto, _BASE, np.uint64)]).astype(np.uint64))
    return _KNOWN


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(item place, document place, words) of the tiles, longest first, then leftmost in the item."""
    reach = max(len(item), len(doc))
    roll_i, roll_d = Rolling(item), Rolling(doc)
    used_i, used_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)

    def free(used: np.ndarray, length: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(used)])
        return sums[length:] == sums[: len(used) - length + 1]

    def shared(length: int) -> tuple[np.ndarray, np.ndarray]:
        """Free places in item and document whose windows of this length have hashes in common."""
        a = np.flatnonzero(free(used_i, length))
        b = np.flatnonzero(free(used_d, length))
        h_a, h_b = roll_i.windows(length, reach)[a], roll_d.windows(length, reach)[b]
        return a[np.isin(h_a, h_b)], b[np.isin(h_b, h_a)]

    tiles = []
    top = min(len(item), len(doc))
    while top >= least:
        low, high = least - 1, top          # longest length that is still shared, by halving
        while low < high:
            mid = (low + high + 1) // 2
            if len(shared(mid)[0]):
                low = mid
            else:
                high = mid - 1
        if low < least:
            break
        places_i, places_d = shared(low)
        hashes = roll_d.windows(low, reach)[places_d]
        order = np.argsort(hashes, kind="stable")
        hashes, places_d = hashes[order], places_d[order]
        for i in places_i:
            if used_i[i: i + low].any():
                continue
            h = roll_i.windows(low, reach)[i]
            for d in places_d[np.searchsorted(hashes, h): np.searchsorted(hashes, h, side="right")]:
                if not used_d[d: d + low].any() and np.array_equal(item[i: i + low], doc[d: d + low]):
                    used_i[i: i + low] = used_d[d: d + low] = True
                    tiles.append((int(i), int(d), low))
                    break
        top = low - 1
    return tiles


class Items:
    """A block of test items with an index of their seeds."""

    def __init__(self, rows: list[tuple[int, str]], seed: int = SEED):
        self.seed = seed
        self.items = [(k, w) for k, t in rows if len(w := words(t or ""))]
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for at, (_, w) in enumerate(self.items):
            size = min(seed, len(w))
            found.setdefault(size, []).append((seeds(w, size), at))
        self.index = {}
        for size, parts in found.items():
            keys = np.concatenate([k for k, _ in parts])
            owner = np.concatenate([np.full(len(k), at) for k, at in parts])
            place = np.concatenate([np.arange(len(k)) for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            self.index[size] = keys[order], owner[order], place[order]

    def candidates(self, doc: np.ndarray, coverage: float) -> list[int]:
        """Items of which the document has seeds that together reach the coverage."""
        out = []
        for size, (keys, owner, place) in self.index.items():
            if len(doc) < size:
                continue
            mine = np.unique(seeds(doc, size))
            low, high = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
            many = high - low
            if not (total := int(many.sum())):
                continue
            hits = np.repeat(low - np.cumsum(many) + many, many) + np.arange(total)
            order = np.lexsort((place[hits], owner[hits]))
            who, at = owner[hits][order], place[hits][order]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            # words from each hit to the item's next one, a whole seed at most and behind the last hit
            step = np.minimum(np.diff(at, append=0), size)
            step[np.append(first[1:], total) - 1] = size
            under = np.add.reduceat(step, first)
            out += who[first][under >= coverage * self.sizes[who[first]]].tolist()
        return out


def seeds(seq: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(seq) - size + 1, np.uint64)
    for k in range(size):
        total = (total + seq[k: k + len(total)]) * np.uint64(_BASE)
        total ^= total >> np.uint64(31)
    return total


def leaks_of(text: str, items: Items, coverage: float = COVERAGE) -> list[tuple]:
    """(item_id, item words, covered words, tiles, share) of each item that the text holds."""
    doc, out = words(text), []
    for k in items.candidates(doc, coverage):
        key, item = items.items[k]
        tiles = tile(item, doc, min(items.seed, len(item)))
        covered = sum(n for _, _, n in tiles)
        if covered and covered >= coverage * len(item):
            out.append((key, len(item), covered, len(tiles), covered / len(item)))
    return out


def _blocks(benchmark: DataFrame, block_chars: int):
    """Blocks of test items, each a broadcast of (item_id, text) rows."""
    spark = benchmark.sparkSession
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    dealt = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield spark.sparkContext.broadcast(
            [(r["item_id"], r["text"]) for r in dealt.filter(F.col("block") == block).collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and each test item that it holds."""
    texts, out = texts_of(docs), None
    for shared in _blocks(benchmark, block_chars):

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, seed)
            for keys, found in each_text(batches):
                got = [(k, *leak) for k, t in zip(keys, found) for leak in leaks_of(t, items, coverage)]
                columns = list(zip(*got)) if got else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                names = ("doc_id", "item_id", "item_words", "covered_words", "tiles", "coverage")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

        part = texts.mapInArrow(find, KINDS)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; nothing is shuffled."""
    out = docs
    for shared in _blocks(benchmark, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, seed)
            for batch in sliced(batches):
                clean = [not leaks_of(t or "", items, coverage) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
