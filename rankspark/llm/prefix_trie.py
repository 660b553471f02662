"""The prefix trie of conversations, built as burst tries.

A turn is named by a hash of its role and text (fixed width), a rebuilt conversation is a string of such
names, cut into blocks of ``BLOCK`` turns at the same depths in all conversations.  The turns before a block are
its trie head, named by the exclusive-or of the hashes of the blocks before it.  So all blocks are worked
on at once, whatever the depth, and no conversation has to fit into one task.

1. Turns are numbered by a range partitioning and offsets of its partitions, so that a conversation may be
   spread over many tasks.
2. Equal blocks under one head are one row with sums (combined before the shuffle): copies cost nothing further on.
3. A container is the set of suffixes under a head.  Containers of more than ``UNITS`` turns burst: the next
   turn names a new head one deeper, its node is summed up without gathering, and the suffixes lose that turn.
4. The remaining containers, bounded by ``UNITS``, are sorted and swept into nodes.

Sums over subtrees need no walk up the trie.  Every node belongs to its smallest member; a conversation owns the
end of its path.  With x = (code points of a member) - (those of the nodes it owns), the saved code points of a node
with n members are sum(x) - x(smallest member) - (n - 1) * (code points above the node), and its leaves are the sum of
the members that own a leaf.  The first pass finds what is owned, the second sums it.

A conversation is a member of every node of its path, the root included; the digest of a node's ends is taken over
sorted pieces of ids, so that no list of members is held.

Edge cases: rows with a null conv_id are left out; null roles and texts are empty; turns are ordered with null
first, turns of one number by the hash of role and text, repeated rows each count; an empty table gives no
rows; columns other than conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import staged

BLOCK, UNITS = 256, 1 << 16
SPAN, MOST = 100, 6      # conversations with one base; turns taken from it are fewer than MOST
NAME = 22                # characters of a turn's name
SUPER = 1024             # blocks whose hashes are chained in one task
PART = 100_000           # turns of one conversation that meet its row in one task
SALTS = 16
PIECE = 1 << 16          # conversation ids in one piece of a list of ends
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "points long, rid string")


def named_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, name, points (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("order"),
        F.substring(F.base64(F.unhex(F.substring(digest, 1, 32))), 1, NAME).alias("name"), F.char_length(text).alias("points"))


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), name, points: places within a conversation, however many tasks it is spread over."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            local = np.arange(len(conv)) - np.repeat(starts, np.diff(starts, append=len(conv)))
            if conv[0] == last:
                local[: starts[1] if len(starts) > 1 else len(conv)] += count
            last, count = int(conv[-1]), int(local[-1]) + 1
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column("conv_id"), "name": batch.column("name"), "points": batch.column("points"),
                "part": pa.array(np.full(len(conv), part), pa.int32()), "local": pa.array(local, pa.int64())})

    # the last key spreads rows that are alike in all others
    keys = ("conv_id", "turn", "order")
    ranged = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys)
    rows = staged(ranged.select("conv_id", "name", "points").mapInArrow(
        number, "conv_id long, name string, points int, part int, local long"))
    edges = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local")).alias("last"))
    offsets, before = [], (None, 0)
    for e in edges.orderBy("part").collect():  # a row for each partition
        begun = before[1] if before[0] == e["first"] else 0
        if begun:
            offsets.append((e["part"], e["first"], begun))
        before = (e["last"]["conv_id"], e["last"]["local"] + 1 + (begun if e["last"]["conv_id"] == e["first"] else 0))
    shift = rows.sparkSession.createDataFrame(offsets, "part int, conv_id long, begun long")
    return rows.join(F.broadcast(shift), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("begun", F.lit(0))).alias("pos"), "name", "points")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 0), name, points of the rebuilt conversations; a row without a name after the last turn."""
    own = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("own"))
    first = turns.filter((F.col("conv_id") % SPAN == 0) & (F.col("pos") < MOST - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "points"))).alias("head"))
    convs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % SPAN).join(first, "base", "left")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST)).cast("int")
    convs = convs.select("conv_id", "own", taken.alias("h"), F.col("head"))
    none = F.array().cast("array<struct<pos:bigint,name:string,points:int>>")
    convs = convs.withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h")), none))
    convs = staged(convs.withColumn("m", F.size("head")))
    parts = convs.filter("own > h").select("conv_id", "h", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("own") - 1) / PART))).alias("part"))
    rest = turns.withColumn("part", F.floor(F.col("pos") / PART)).join(parts, ["conv_id", "part"]).filter("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "name", "points")
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.name", "t.points")
    end = convs.select("conv_id", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("depth"),
                       F.lit(None).cast("string").alias("name"), F.lit(0).alias("points"))
    return rest.unionByName(taken).unionByName(end)


def blocks(turns: DataFrame, block: int) -> DataFrame:
    """conv_id, depth (of its head), head, seg (names), lens, before (code points above), total, ended, rid.

    rid names equal blocks under one head.  The block of a conversation's end has ``ended``, and may have no turn.
    """
    keyed = turns.withColumn("block", F.floor(F.col("depth") / block)).withColumn("super", F.floor(F.col("block") / SUPER))
    # one shuffle for the blocks and for the chain of their hashes
    grouped = keyed.repartition("conv_id", "super").groupBy("conv_id", "super", "block").agg(
        F.array_sort(F.collect_list(F.struct("depth", "name", "points"))).alias("turns"))
    real = F.filter("turns", lambda t: t["name"].isNotNull())
    grouped = grouped.select("conv_id", "super", "block", F.exists("turns", lambda t: t["name"].isNull()).alias("ended"), real.alias("turns"))
    grouped = grouped.select("conv_id", "super", "block", "ended", F.array_join("turns.name", "").alias("seg"), F.col("turns.points").alias("lens"),
                             F.aggregate("turns.points", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    digest = F.sha2(F.concat_ws(":", "block", "seg").cast("binary"), 256)
    grouped = grouped.withColumn("digest", digest)
    lane = (lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long"))
    grouped = grouped.withColumn("d1", lane(1)).withColumn("d2", lane(16))
    within = Window.partitionBy("conv_id", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    chained = staged(grouped.select("conv_id", "super", "block", "ended", "seg", "lens", "total", "digest", "d1", "d2", *_sums(within)))
    across = Window.partitionBy("conv_id").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    totals = chained.groupBy("conv_id", "super").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("total").alias("total"))
    later = totals.select("conv_id", "super", *[c.alias(f"far_{n}") for n, c in zip(("h1", "h2", "before"), _sums(across))]).filter("super > 0")
    whole = chained.join(later, ["conv_id", "super"], "left")
    far = (lambda n: F.coalesce(f"far_{n}", F.lit(0).cast("long")))
    head = F.md5(F.concat_ws(":", "block", F.col("h1").bitwiseXOR(far("h1")), F.col("h2").bitwiseXOR(far("h2"))).cast("binary"))
    return whole.select("conv_id", (F.col("block") * block).alias("depth"), head.alias("head"), "seg", "lens",
                        (F.col("before") + far("before")).alias("before"), "total", "ended", "digest").withColumn(
        "rid", F.md5(F.concat_ws(":", "head", "ended", "digest").cast("binary"))).drop("digest")


def _sums(window) -> list:
    none = F.lit(0).cast("long")
    return [F.coalesce(F.bit_xor("d1").over(window), none).alias("h1"), F.coalesce(F.bit_xor("d2").over(window), none).alias("h2"),
            F.coalesce(F.sum("total").over(window), none).alias("before")]


def sweep(rows: list[tuple]) -> Iterator[tuple]:
    """Nodes of one container: rows (depth, seg, lens, before, ended, rid, n, least, x_least, x, leaf) sorted by seg.

    The container's head comes last, with nothing but the number of its children and the rid that ends there.
    """
    depth, points, above, parent, rids, sums = [], [], [], [], [], []
    path: list[int] = []
    prior = ""
    for d, seg, lens, before, ended, rid, n, least, x_least, x, leaf in rows:
        shared = min(len(os.path.commonprefix((prior, seg))) // NAME, len(path))
        del path[shared:]
        so_far = before + sum(lens[:shared])
        for k in range(shared, len(seg) // NAME):
            depth.append(d + k + 1)
            points.append(lens[k])
            above.append(so_far)
            parent.append(path[-1] if path else -1)
            rids.append(None)
            sums.append([0, None, 0, 0])
            path.append(len(depth) - 1)
            so_far += lens[k]
        prior = seg
        if path:
            own = sums[path[-1]]
            own[0] += n
            own[2] += x
            own[3] += leaf
            own[1] = (least, x_least) if own[1] is None else min(own[1], (least, x_least))
            if ended:
                rids[path[-1]] = rid
    children = [0] * len(depth)
    for k in range(len(depth) - 1, -1, -1):
        p = parent[k]
        if p >= 0:
            children[p] += 1
            mine, theirs = sums[k], sums[p]
            theirs[0] += mine[0]
            theirs[2] += mine[2]
            theirs[3] += mine[3]
            theirs[1] = mine[1] if theirs[1] is None else min(theirs[1], mine[1])
    top = min(r[7] for r in rows)
    for k in range(len(depth)):
        n, (least, x_least), x, leaf = sums[k]
        over = sums[parent[k]][1][0] if parent[k] >= 0 else top
        yield least, depth[k], over, n, children[k], leaf, x - x_least - (n - 1) * above[k], points[k], rids[k]
    ends = [rid for _, seg, _, _, ended, rid, *_ in rows if ended and not seg]
    if depth or ends:
        yield top, rows[0][0], None, 0, parent.count(-1), 0, 0, 0, max(ends, default=None)


_ROW = ("depth", "seg", "lens", "before", "ended", "rid", "n", "least", "x_least", "x", "leaf")


def _swept(rows: DataFrame) -> DataFrame:
    """Containers sorted and swept, one at a time."""
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _NODE.split(", ")])

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, out = None, [], []
        for batch in batches:
            heads = batch.column("head").to_pylist()
            for at, row in zip(heads, zip(*(batch.column(c).to_pylist() for c in _ROW))):
                if at != head and held:
                    out.extend(sweep(held))
                    held = []
                    if len(out) > 4096:
                        yield table(out)
                        out = []
                head = at
                held.append(row)
        if held:
            out.extend(sweep(held))
        if out:
            yield table(out)

    return rows.select("head", *_ROW).repartition("head").sortWithinPartitions("head", "seg").mapInArrow(run, _NODE)


def _nodes(rows: DataFrame, units: int) -> DataFrame:
    """Nodes of all containers below the root; heads have a row of their own for each container that found children."""
    done, found = [], []
    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")
    while True:
        sizes = rows.groupBy("head").agg(F.sum(F.length("seg") / NAME + 1).alias("units"), F.min("least").alias("up"))
        big = staged(sizes.filter(F.col("units") > units).select("head", "up"))
        if big.isEmpty():
            done.append(rows)
            break
        dealt = big.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        tagged = staged(rows.withColumn("salt", salt).join(dealt, ["head", "salt"], "left").drop("salt"))
        done.append(tagged.filter("up is null").drop("up"))
        hot = tagged.filter("up is not null")
        burst = hot.filter("seg <> ''").withColumn("next", F.substring("seg", 1, NAME)).withColumn("size", F.col("lens")[0])
        last = F.when(F.col("ended") & (F.length("seg") == NAME), F.col("rid"))
        nodes = staged(burst.groupBy("head", "next").agg(
            F.min("depth").alias("depth"), F.min("up").alias("up"), F.min("before").alias("before"), F.min("size").alias("points"), F.sum("n").alias("n"),
            F.min(F.struct("least", "x_least")).alias("top"), F.sum("x").alias("x"), F.sum("leaf").alias("leaf"), F.max(last).alias("rid")))
        found.append(nodes.select(
            F.col("top.least").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.lit(0).cast("long").alias("n_children"), F.col("leaf").alias("n_leaves"),
            (F.col("x") - F.col("top.x_least") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"), F.col("points").cast("long"), "rid"))
        zero = F.lit(0).cast("long")
        ends = hot.filter("seg = '' and ended").select("head", "up", "depth", F.lit(0).alias("one"), "rid")
        heads = nodes.select("head", "up", "depth", F.lit(1).alias("one"), F.lit(None).cast("string").alias("rid")).unionByName(ends)
        found.append(heads.groupBy("head", "up", "depth").agg(F.sum("one").alias("many"), F.max("rid").alias("rid")).select(
            F.col("up").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), zero.alias("n_convs"), F.col("many").alias("n_children"),
            zero.alias("n_leaves"), zero.alias("saved_tokens"), zero.alias("points"), "rid"))
        rows = burst.withColumn("head", F.md5(F.concat("head", "next").cast("binary"))).withColumn("seg", F.substring("seg", NAME + 1, 1 << 30)).withColumn(
            "before", F.col("before") + F.col("size")).withColumn("lens", F.slice("lens", F.lit(2), F.size("lens"))).withColumn(
            "depth", F.col("depth") + 1).drop("up", "next", "size")
    rest = done[0].select("head", *_ROW)
    for frame in done[1:]:
        rest = rest.unionByName(frame.select("head", *_ROW))
    out = _swept(rest)
    for frame in found:
        out = out.unionByName(frame)
    return out


def _trie(members: DataFrame, segs: DataFrame, values: DataFrame | None, units: int) -> DataFrame:
    """Nodes with sums of what ``values`` (conv_id, x, leaf) says of their members."""
    rows = members.select("conv_id", "rid")
    if values is None:
        zero = F.lit(0).cast("long")
        rows = rows.withColumn("x", zero).withColumn("leaf", zero)
    else:
        rows = rows.join(values, "conv_id")
    summed = rows.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", "x")).alias("top"), F.sum("x").alias("x"), F.sum("leaf").alias("leaf"))
    rows = staged(segs.join(summed, "rid").select("*", F.col("top.conv_id").alias("least"), F.col("top.x").alias("x_least")).drop("top"))
    root = rows.filter("depth = 0").agg(
        F.min(F.struct("least", "x_least")).alias("top"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("leaf").alias("leaf"),
        F.max(F.when(F.col("ended") & (F.col("seg") == ""), F.col("rid"))).alias("rid")).filter("n > 0")
    zero = F.lit(0).cast("long")
    root = root.select(F.col("top.least").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                       zero.alias("n_children"), F.col("leaf").alias("n_leaves"), (F.col("x") - F.col("top.x_least")).alias("saved_tokens"), zero.alias("points"), "rid")
    whole = _nodes(rows, units).unionByName(root).groupBy("conv_id", "depth").agg(
        F.max("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "points")], F.max("rid").alias("rid"))
    return staged(whole)


def end_digests(ended: DataFrame) -> DataFrame:
    """rid and the hash of its conversations' ids, ascending and joined by commas."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of the lists that lie within a partition, pieces of those that may go on in another."""
        rid, ids, whole, out = None, [], False, []

        def closed(complete: bool):
            text = ",".join(map(str, ids))
            out.append((rid, ids[0], None if complete else text, hashlib.sha256(text.encode()).hexdigest() if complete else None))

        for batch in batches:
            for r, c in zip(batch.column("rid").to_pylist(), batch.column("conv_id").to_pylist()):
                if r != rid:
                    if ids:
                        closed(whole)
                    whole, ids = rid is not None, []
                    rid = r
                elif len(ids) == PIECE:
                    closed(False)
                    whole, ids = False, []
                ids.append(c)
            if out:
                yield table(out)
                out = []
        if ids:
            closed(False)
            yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        rid, first, piece, digest = zip(*rows)
        return pa.RecordBatch.from_pydict({"rid": pa.array(rid, pa.string()), "first": pa.array(first, pa.int64()),
                                           "piece": pa.array(piece, pa.string()), "ends_sha256": pa.array(digest, pa.string())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, digest = None, None
        for batch in batches:
            out = []
            for r, piece in zip(batch.column("rid").to_pylist(), batch.column("piece").to_pylist()):
                if r == rid:
                    digest.update(b",")
                else:
                    if rid is not None:
                        out.append((rid, digest.hexdigest()))
                    rid, digest = r, hashlib.sha256()
                digest.update(piece.encode())
            if out:
                yield pa.RecordBatch.from_pydict({"rid": [x[0] for x in out], "ends_sha256": [x[1] for x in out]})
        if rid is not None:
            yield pa.RecordBatch.from_pydict({"rid": [rid], "ends_sha256": [digest.hexdigest()]})

    keys = ("rid", "conv_id")
    first = staged(ended.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        cut, "rid string, first long, piece string, ends_sha256 string"))
    later = first.filter("piece is not null").select("rid", "first", "piece").repartition("rid").sortWithinPartitions("rid", "first")
    return first.filter("piece is null").select("rid", "ends_sha256").unionByName(
        later.mapInArrow(joined, "rid string, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK, units: int = UNITS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    members = staged(blocks(rebuilt(placed(named_turns(conversations))), block))
    segs = staged(members.select("rid", "head", "depth", "seg", "lens", "before", "ended").dropDuplicates(["rid"]))
    first = _trie(members, segs, None, units)
    owned = first.groupBy("conv_id").agg(F.sum("points").alias("owned"))
    leaves = first.filter("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    total = members.groupBy("conv_id").agg(F.sum("total").alias("total"))
    zero = F.lit(0).cast("long")
    values = staged(total.join(owned, "conv_id", "left").join(leaves, "conv_id", "left").select(
        "conv_id", (F.col("total") - F.coalesce("owned", zero)).alias("x"), F.coalesce("leaf", zero).alias("leaf")))
    nodes = _trie(members, segs, values, units).drop("points")
    ends = end_digests(members.filter("ended"))
    nothing = nodes.filter("rid is null").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return nodes.filter("rid is not null").join(ends, "rid").unionByName(nothing).drop("rid")
