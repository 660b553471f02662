"""Removal of repeated passages by suffix arrays.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts elsewhere in the corpus.

1. Every window of ``WIDTH`` bytes is named by the smallest hash among the ``GRAM``-byte strings in it.
   Neighbouring windows mostly share their name, so a document is a few runs, and equal windows have
   equal names wherever they stand.  Names of one run are done with, as nothing under them repeats,
   unless the naming string stands in that run more than once.
2. If all runs of a name have the same bytes, they repeat as a whole.  Of the other names, one run for
   each different string of bytes is fetched, with its number of copies.
3. These strings go to shards of about ``SHARD_BYTES``, by name; a name of more than ``HOT`` different
   strings is dealt over all shards.  A shard builds a suffix array by Larsson-Sadakane refinement
   (``suffix_order``) and common prefixes by Kasai's rule (``common_prefixes``): windows with a neighbour
   of ``WIDTH`` common bytes repeat.
4. Names dealt over several shards are merged: each shard gives the sorted fingerprints of its different
   windows, and ranges of fingerprints are searched for in each other's lists by halving.
5. Spans go back to all runs with those bytes, and from there to the documents.

Edge cases: null and empty texts, and texts under ``WIDTH`` bytes, keep all they have; every row is a
document of its own, so that a repeated row repeats all its windows; a row with a null doc_id counts
like any other; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import staged, texts_of
from rankspark.llm.minhash import mixed

WIDTH, GRAM = 200, 16
BLOCK = 1 << 18          # bytes of text looked at together
SHARD_BYTES, HOT = 2 << 20, 2048
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _packed(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big-endian number; bytes after the end count as 0."""
    x = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x[: len(raw)]


def _extreme(x: np.ndarray, span: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``span`` neighbours, by doubling."""
    size, out, n = 1, x, len(x) - span + 1
    while 2 * size <= span:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[:n], out[span - size: span - size + n])


def names(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the GRAM bytes from each place, and the name of each window of WIDTH bytes."""
    eight = _packed(raw)
    n = len(raw) - GRAM + 1
    gram = mixed(eight[:n] * _A + eight[8: n + 8] * _B)
    return gram, _extreme(gram, WIDTH - GRAM + 1, np.minimum)


def seen_twice(gram: np.ndarray, name: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each run of windows [start, end): whether the string that names it stands in it more than once."""
    span = WIDTH - GRAM + 1
    pad = np.zeros(span - 1, np.uint64)
    naming = np.flatnonzero(gram == _extreme(np.concatenate([pad, name, pad]), span, np.maximum))
    kinds, kind = np.unique(gram[naming], return_inverse=True)
    place = np.sort((kind.astype(np.int64) << 32) | naming)
    mine = np.searchsorted(kinds, name[start]).astype(np.int64) << 32
    return np.searchsorted(place, mine | (end + span - 1)) - np.searchsorted(place, mine | start) > 1


def runs(raw: bytes) -> list[tuple[int, int, bool, int, int]]:
    """(place, windows, twice, name, digest of the bytes) of each run of windows of one text."""
    out = []
    data = np.frombuffer(raw, np.uint8)
    last = len(raw) - WIDTH + 1
    for block in range(0, max(last, 0), BLOCK):
        n = min(BLOCK, last - block)
        gram, name = names(data[block: block + n + WIDTH - 1])
        cut = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        end = np.append(cut[1:], n)
        twice = seen_twice(gram, name, cut, end)
        held = name[cut].view(np.int64)
        for at, size, two, value in zip((cut + block).tolist(), (end - cut).tolist(), twice.tolist(), held.tolist()):
            digest = xxhash.xxh3_64_intdigest(raw[at: at + size + WIDTH - 1])
            out.append((at, size, two, value, digest - (1 << 63)))
    return out


def suffix_order(raw: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Places sorted by the bytes from there on, at least ``depth`` deep, ties by place.

    Larsson-Sadakane: places start in groups by their first eight bytes; each round sorts only the
    places of groups that are not yet single, by the group of the place ``h`` further on, and doubles h.
    """
    n = len(raw)
    key = _packed(raw)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.empty(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    h = 8
    while True:
        heads = np.flatnonzero(fresh)
        group = np.repeat(heads, np.diff(heads, append=n))
        rank[order] = group
        if h >= depth:
            return order
        size = np.repeat(np.diff(heads, append=n), np.diff(heads, append=n))
        todo = np.flatnonzero(size > 1)
        if not len(todo):
            return order
        places = order[todo]
        after = rank[np.minimum(places + h, n)] + 1
        both = (group[todo] << 32) | after
        by = np.argsort(both, kind="stable")
        order[todo] = places[by]
        both = both[by]
        fresh[todo] = np.concatenate([[True], both[1:] != both[:-1]])
        h *= 2


def common_prefixes(raw: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each place in the order has in common with the one before it (0 for the first).

    Kasai's rule: going through the text, if the predecessor moves on by one as the place does, the
    common prefix is one less.  Only places where that does not hold are compared, eight bytes at a time.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (raw[:-1] == raw[before[:-1]])
    start = np.flatnonzero(~follows)
    eight = _packed(raw)
    length = np.zeros(n, np.int64)
    live = start[before[start] >= 0]
    other = before[live]
    done = np.zeros(len(live), np.int64)
    index = np.arange(len(live))
    while len(index):
        a, b = live[index] + done[index], other[index] + done[index]
        inside = np.maximum(a, b) < n
        index, a, b = index[inside], a[inside], b[inside]
        same = eight[a] == eight[b]
        differ = eight[a[~same]] ^ eight[b[~same]]
        # equal leading bytes of two different numbers, and never over the end of the text
        zeros = np.zeros(len(differ), np.int64)
        for k in range(1, 8):
            zeros += (differ >> np.uint64(64 - 8 * k)) == 0
        done[index[~same]] += zeros
        done[index[same]] += 8
        index = index[same]
    length[live] = np.minimum(done, n - np.maximum(live, other))
    source = np.maximum.accumulate(np.where(follows, -1, np.arange(n)))
    length = np.maximum(length[source] - (np.arange(n) - source), 0)
    return length[order]


def ranges_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def repeats_in_shard(bodies: list[bytes], copies: list[int]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Windows of a shard's strings: flags by place, first place of each class, and starts of the strings."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    valid, weight = np.zeros(len(raw), bool), np.zeros(len(raw), np.int64)
    for a, size, c in zip(starts, sizes, copies):
        valid[a: a + size - WIDTH + 1] = True
        weight[a: a + size] = c
    order = suffix_order(raw)
    common = common_prefixes(raw, order)
    kept = np.flatnonzero(valid[order])
    places = order[kept]
    # common prefix with the window before: the least on the way from there
    least = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1])) if len(kept) else common[:0]
    head = np.ones(len(kept), bool)
    head[1:] = least[1:] < WIDTH
    heads = np.flatnonzero(head)
    total = np.add.reduceat(weight[places], heads) if len(heads) else weight[:0]
    repeated = np.zeros(len(raw), bool)
    repeated[places[np.repeat(total > 1, np.diff(heads, append=len(kept)))]] = True
    return repeated, places[heads], starts


FOUND = "value long, digest long, a int, b int, range int, shard long, prints binary"
#: A window that other shards may have: fingerprint, its string, its place there, and whether it repeats here.
_PRINT = np.dtype([("f1", "<i8"), ("f2", "<i8"), ("value", "<i8"), ("digest", "<i8"), ("a", "<i4"), ("here", "?")])


def search_shard(frame: pd.DataFrame, n_ranges: int = 1) -> pd.DataFrame:
    """Ranges of repeated windows by string; for strings of names that other shards have too, the
    fingerprints of the different windows as well, a row of sorted ones for each range of fingerprints."""
    frame = frame.sort_values(["value", "digest"]).reset_index(drop=True)
    bodies = [bytes(b) for b in frame["body"]]
    repeated, heads, starts = repeats_in_shard(bodies, frame["copies"].tolist())
    shard = int(frame["shard"].iloc[0])
    values, digests = frame["value"].tolist(), frame["digest"].tolist()
    rows = []
    for k in range(len(bodies)):
        rows += [(values[k], digests[k], a, b, None, shard, None) for a, b in ranges_of(repeated[starts[k]: starts[k + 1]])]
    hot = frame["hot"].to_numpy(bool)
    owner = np.searchsorted(starts, heads, side="right") - 1
    mine = np.flatnonzero(hot[owner])
    if len(mine):
        prints = np.empty(len(mine), _PRINT)
        for at, (place, k) in enumerate(zip(heads[mine].tolist(), owner[mine].tolist())):
            a = place - int(starts[k])
            sign = xxhash.xxh3_128_intdigest(bodies[k][a: a + WIDTH])
            prints[at] = ((sign >> 64) - (1 << 63), (sign & (2**64 - 1)) - (1 << 63), values[k], digests[k], a, repeated[place])
        prints.sort(order=["f1", "f2"])
        part = prints["f1"] % n_ranges
        rows += [(None, None, None, None, int(r), shard, prints[part == r].tobytes()) for r in np.unique(part)]
    columns = list(zip(*rows)) if rows else [[]] * 7
    kinds = ("Int64", "Int64", "Int32", "Int32", "Int32", "int64", object)  # whole numbers, even beside nulls
    fields = ("value", "digest", "a", "b", "range", "shard", "prints")
    return pd.DataFrame({n: pd.Series(list(c), dtype=k) for n, c, k in zip(fields, columns, kinds)})


def merge_range(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows that some other shard has too: each shard's sorted fingerprints are looked for in the
    sorted ones of all shards by halving."""
    lists = [np.frombuffer(p, _PRINT) for p in frame["prints"]]
    keys = [p[["f1", "f2"]].copy().astype([("x", "<i8"), ("y", "<i8")]) for p in lists]
    every = np.sort(np.concatenate(keys))
    found = []
    for prints, mine in zip(lists, keys):
        many = np.searchsorted(every, mine, side="right") - np.searchsorted(every, mine, side="left")
        found.append(prints[(many > 1) & ~prints["here"]])
    got = np.concatenate(found)
    return pd.DataFrame({"value": got["value"], "digest": got["digest"], "a": got["a"], "b": got["a"] + 1})


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key by content: rows with equal keys are equal, and so are their results."""
    return texts_of(docs).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"))


def _run_rows(keyed: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        columns = ["k1", "k2", "place", "windows", "twice", "value", "digest"]
        for batch in batches:
            rows = [[] for _ in kinds]
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
                found = runs(text.encode())
                if found:
                    for held, part in zip(rows, ([k1] * len(found), [k2] * len(found), *zip(*found))):
                        held += part
                if len(rows[0]) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=columns)
                    rows = [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=columns)

    return keyed.select("k1", "k2", "text").mapInArrow(
        make, "k1 long, k2 long, place int, windows int, twice boolean, value long, digest long")


def _bodies(wanted: DataFrame, keyed: DataFrame) -> DataFrame:
    """The bytes of chosen runs, fetched document by document."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(
        F.struct("place", "windows", "value", "digest", "copies", "hot", "shard")).alias("runs"))
    met = lists.join(keyed.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), "text"),
                     (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))).select("runs", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.int64()), ("digest", pa.int64()), ("copies", pa.int64()), ("hot", pa.bool_()),
                            ("shard", pa.int64()), ("body", pa.binary())])
        for batch in batches:
            rows = []
            for wanted_runs, text in zip(batch.column("runs").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                rows += [{**{k: r[k] for k in schema.names[:-1]},
                          "body": raw[r["place"]: r["place"] + r["windows"] + WIDTH - 1]} for r in wanted_runs]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = met.mapInArrow(cut, "value long, digest long, copies long, hot boolean, shard long, body binary")
    # equal rows have equal keys: one of their strings is enough
    return found


def repeated_spans(keyed: DataFrame, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans) with the byte spans of repeated windows, overlaps not joined, of documents that have any."""
    every = staged(_run_rows(keyed))
    shared = staged(every.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("d0"), F.max("digest").alias("d1"),
                                                 F.max("twice").alias("twice"))
                    .filter("n > 1 or twice")
                    .select("value", ((F.col("n") > 1) & (F.col("d0") == F.col("d1"))).alias("same")))
    again = staged(every.drop("twice").join(shared, "value"))

    strings = staged(again.filter(~F.col("same")).groupBy("value", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "place", "windows")).alias("one"))
        .select("value", "digest", "copies", "one.*"))
    size = strings.agg(F.sum(F.col("windows") + (WIDTH - 1))).first()[0] or 0
    spans = again.filter("same").select("k1", "k2", F.col("place").alias("start"),
                                        (F.col("place") + F.col("windows") + (WIDTH - 1)).alias("end"))
    if size:
        shards = max(1, math.ceil(size / shard_bytes))
        many = staged(strings.groupBy("value").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > hot))
        dealt = strings.join(many, "value", "left").withColumn("hot", F.col("many").isNotNull() & F.lit(shards > 1))
        own = F.pmod(F.xxhash64("value"), F.lit(shards))
        spread = F.pmod(F.xxhash64("value", "digest"), F.lit(shards))
        dealt = dealt.withColumn("shard", F.when(F.col("hot"), spread).otherwise(own))
        n_ranges = max(1, shards // 2)

        def search(frame: pd.DataFrame) -> pd.DataFrame:
            return search_shard(frame, n_ranges)

        found = staged(_bodies(dealt, keyed).groupBy("shard").applyInPandas(search, FOUND))
        ranges = found.filter("prints is null").select("value", "digest", "a", "b")
        met = found.filter("prints is not null").groupBy("range").applyInPandas(
            merge_range, "value long, digest long, a int, b int")
        ranges = ranges.unionByName(met)
        by_string = staged(ranges.groupBy("value", "digest").agg(F.collect_list(F.struct("a", "b")).alias("ranges")))
        part = again.filter(~F.col("same")).join(by_string, ["value", "digest"]).select(
            "k1", "k2", "place", F.explode("ranges").alias("r"))
        spans = spans.unionByName(part.select("k1", "k2", (F.col("place") + F.col("r.a")).alias("start"),
                                              (F.col("place") + F.col("r.b") + (WIDTH - 1)).alias("end")))
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of every row."""
    keyed = _keyed(docs)
    gone = staged(repeated_spans(keyed, shard_bytes, hot)).select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "spans")
    met = keyed.join(gone, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = text.encode()
                out = joined_spans([(s["start"], s["end"]) for s in spans or []])
                edges = [0, *(x for s in out for x in s), len(raw)]
                kept = hashlib.sha256(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                rows.append((len(raw), sum(b - a for a, b in out), len(out), kept.hexdigest(), [{"start": a, "end": b} for a, b in out]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return met.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                  "removed array<struct<start:int,end:int>>")
