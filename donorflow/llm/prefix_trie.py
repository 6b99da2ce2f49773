"""A trie of conversations: union-find over the common prefixes of sorted neighbours, one forest a block, merged across blocks.

1. Every turn is known by a 128-bit hash; conversations with the same turns are one row with a count. These rows are sorted
   by their turns over range partitions, so each node of the trie is a stretch of neighbours.
2. In a block of sorted rows, edges between neighbours are joined in descending order of their common prefix. Each merge of
   two components makes a branching node (or joins the one of that depth); the depths between two branching nodes share its
   members.
3. Only nodes on the paths of a block's first and last row can go on in other blocks. A block's forest is contracted to these
   open nodes, with sums over what hangs below them; they are merged by the hash of their turns, and what they add to
   their ancestors goes up each block's two paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorflow.llm.common import checkpointed, tidy
from donorflow.llm.repeats import written

BLOCK_TURNS = 100_000
CHUNK = 1 << 16
NODE = "block long, open boolean, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
NAMES = [x.split()[0] for x in NODE.split(", ")]
TYPES = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in NODE.split(", ")]


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as (id, size), the hash of role and text and the text's code points.

    Null turn numbers come first, equal ones in order of the hashes. Null roles and texts are empty ones. Rows without a
    conversation are left out; other columns are not read.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    name = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    item = F.struct(F.col(turn).alias("turn"), name.alias("id"), F.length(t).cast("long").alias("size"))
    turns = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), item.alias("item"))
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return held.select("conv_id", F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("turns"))


def rebuilt(held: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Sequences that begin with the first h turns of the conversation c - c % group; h = crc32(decimal c) % (most + 1).

    A conversation's own turns follow after its first h. If the other has fewer turns, all of them come; if there is none, none.
    """
    held = checkpointed(held)
    heads = held.select(F.col("conv_id").alias("of"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    joined = held.join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("of"), "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def ends_digests(held: DataFrame) -> DataFrame:
    """(name, ends_sha256): digest of the ids of equal sequences, ascending and joined by commas. held: (name, conv_id).

    Ids are sorted over ranges, so that one name's ids fill many tasks, and joined there to pieces of 64 KB; only these
    pieces of a name meet in one task, which feeds them to the digest one after another.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for x, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (x != name or size >= CHUNK):
                    out.append((name, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    name, first = x, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield piece_rows(out)
        if held:
            yield piece_rows([(name, first, ",".join(held))])

    def piece_rows(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["name", "first", "text"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            out = []
            for x, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if x != name:
                    if digest:
                        out.append((name, digest.hexdigest()))
                    name, digest = x, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.as_buffer())
            if out:
                yield digest_rows(out)
        if digest:
            yield digest_rows([(name, digest.hexdigest())])

    def digest_rows(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], names=["name", "ends_sha256"])

    ranged = held.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    joined = ranged.mapInArrow(tidy(pieces), "name binary, first long, text string")
    return joined.repartition("name").sortWithinPartitions("name", "first").mapInArrow(tidy(digests), "name binary, ends_sha256 string")


def common_prefixes(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many first items each sequence shares with the next; sequence i is ids[begin[i]:begin[i + 1]], items are rows."""
    most = np.minimum(np.diff(begin)[:-1], np.diff(begin)[1:])
    stops = np.cumsum(most)
    step = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - most, most)
    differs = np.flatnonzero((ids[np.repeat(begin[:-2], most) + step] != ids[np.repeat(begin[1:-1], most) + step]).any(1))
    at = np.searchsorted(differs, stops - most)
    first = np.append(differs, np.iinfo(np.int64).max)[at]
    return np.where(first < stops, first - (stops - most), most)


class Forest:
    """Branching nodes and ends of sorted, different sequences: depth, parent, and one sequence below each."""

    def __init__(self, lengths: np.ndarray, common: np.ndarray):
        self.depth = lengths.tolist()
        self.one = list(range(len(lengths)))
        self.parent = [-1] * len(lengths)
        above = list(range(len(lengths)))  # union-find
        top = list(range(len(lengths)))
        common = common.tolist()

        def find(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        for e in sorted(range(len(common)), key=lambda e: -common[e]):  # equal depths from the left, as sorted() is stable
            a, b, d = find(e), find(e + 1), common[e]
            node = top[a]
            if self.depth[node] != d:
                node = self.branch(d, a)
                self.parent[top[a]] = node
            self.parent[top[b]] = node
            above[b] = a
            top[a] = node
        last = top[find(0)]
        if self.depth[last]:
            self.parent[last] = self.branch(0, 0)

    def branch(self, depth: int, one: int) -> int:
        self.depth.append(depth)
        self.one.append(one)
        self.parent.append(-1)
        return len(self.depth) - 1


def path_keys(ids: np.ndarray) -> list[bytes]:
    """Hashes of the prefixes of a sequence, the empty one's first."""
    keys = [b""]
    for x in ids:
        keys.append(hashlib.md5(keys[-1] + x.tobytes()).digest())
    return keys


def block_nodes(block: int, ids: np.ndarray, sizes: np.ndarray, begin: np.ndarray, members: list, convs: list, ends: list) -> pa.RecordBatch:
    """All nodes of a block's sequences: closed ones whole, open ones with what the block adds to them."""
    lengths = np.diff(begin)
    forest = Forest(lengths, common_prefixes(ids, begin))
    count, leaves_in = len(forest.depth), len(lengths)
    n, conv = [0] * count, [None] * count
    kids, leaves, saved, far = [0] * count, [0] * count, [0] * count, [0] * count
    for i in range(leaves_in):
        n[i], conv[i] = members[i], convs[i]
    sums = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    begin = begin.tolist()
    left, right = path_keys(ids[begin[0] : begin[1]]), path_keys(ids[begin[-2] : begin[-1]])
    opened = {}
    for end, keys in ((0, left), (leaves_in - 1, right)):
        node = end
        while node >= 0:
            opened[node] = keys
            node = forest.parent[node]
    order = sorted(range(count), key=lambda x: -forest.depth[x])
    for x in order:
        p, d = forest.parent[x], forest.depth[x]
        far[x] = forest.depth[p] if p >= 0 else -1
        if not kids[x] and x not in opened:
            leaves[x] = 1
        if p < 0:
            continue
        n[p] += n[x]
        conv[p] = conv[x] if conv[p] is None else min(conv[p], conv[x])
        at = begin[forest.one[x]]
        leaves[p] += leaves[x]
        saved[p] += saved[x]
        if x not in opened:
            kids[p] += 1
            saved[p] += (n[x] - 1) * (sums[at + d] - sums[at + far[x]])
    out = []
    for x in range(count):
        keys, at, d, p = opened.get(x), begin[forest.one[x]], forest.depth[x], forest.parent[x]
        for k in range(far[x] + 1, d + 1):
            end = ends[x] if x < leaves_in and k == d else None
            size = sums[at + k] - sums[at + k - 1] if k else 0
            if keys:
                out.append((block, True, keys[k], keys[k - 1] if k else None, k, conv[x], None, n[x], kids[x] if k == d else 0, leaves[x], saved[x], size, end))
                continue
            hangs = opened.get(p) if k == far[x] + 1 else None
            above = None if hangs else conv[p] if k == far[x] + 1 else conv[x]
            out.append((block, False, None, hangs[k - 1] if hangs else None, k, conv[x], above, n[x], kids[x] if k == d else 1, leaves[x], saved[x] + (n[x] - 1) * (sums[at + d] - sums[at + k - 1]), size, end))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)


def forests(rows: DataFrame, turns: int) -> DataFrame:
    """NODE rows of blocks of sorted sequences (ids, sizes, n, conv_id, ends_sha256) with about `turns` turns each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            at = 0
            lengths = np.cumsum(pa.compute.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False) + 1)
            while at < batch.num_rows:
                before = lengths[at - 1] if at else 0
                stop = min(max(int(np.searchsorted(lengths, before + turns - size)), at + 1), batch.num_rows)
                held.append(batch.slice(at, stop - at))
                size += int(lengths[stop - 1] - before)
                at = stop
                if size >= turns:
                    yield nodes(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield nodes(block, held)

    def nodes(block: int, held: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = pa.concat_arrays(t.column("ids").chunks)
        begin = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = lists.flatten().cast(pa.binary(16))
        ids = np.frombuffer(flat.buffers()[1], np.uint64, 2 * len(flat), 16 * flat.offset).reshape(-1, 2) if len(flat) else np.zeros((0, 2), np.uint64)
        sizes = pa.concat_arrays(t.column("sizes").chunks).flatten().to_numpy(zero_copy_only=False)
        return block_nodes(block, ids, sizes, begin, *[t.column(c).to_pylist() for c in ("n", "conv_id", "ends_sha256")])

    return rows.mapInArrow(tidy(work), NODE)


def risen(nodes: pd.DataFrame) -> pd.DataFrame:
    """What the open nodes of one block add to themselves and their ancestors."""
    nodes = nodes.sort_values("depth", ascending=False)
    sums: dict = {}
    out = []
    for key, parent, leaf, own in zip(nodes["key"], nodes["parent"], nodes["leaf"], nodes["own"], strict=True):
        a, b = sums.pop(key, (0, 0))
        a, b = a + leaf, b + own
        out.append((key, a, b))
        if parent is not None:
            c, d = sums.get(parent, (0, 0))
            sums[parent] = (a + c, b + d)
    return pd.DataFrame(out, columns=["key", "leaf", "own"])


def trie(held: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    held: (conv_id, turns) as sequences() gives, one row a conversation. A node is a different sequence of first turns, the
    root at depth 0; its members are the conversations that begin with it, conv_id the smallest of them. saved_tokens sums
    (members - 1) times the code points of the last text over the node's subtree, n_leaves counts its nodes without
    children, ends_sha256 digests the ids of the conversations that end here.

    Conversations without turns belong to the root; without any conversation there are no rows. Memory: a block of about
    `block_turns` turns, or one longer conversation. Equality of turns is that of 128-bit hashes.
    """
    ids = F.transform("turns", lambda x: x["id"])
    named = checkpointed(held.select("conv_id", "turns", F.unhex(F.md5(F.array_join(F.transform(ids, F.hex), "").cast("binary"))).alias("name")))
    classes = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
    classes = classes.join(ends_digests(named), "name")
    rows = classes.select(ids.alias("ids"), F.transform("turns", lambda x: x["size"]).alias("sizes"), "n", "conv_id", "ends_sha256")
    nodes = written(forests(rows.repartitionByRange("ids").sortWithinPartitions("ids"), block_turns), "forest")
    opened = nodes.filter("open")
    merged = checkpointed(opened.groupBy("key").agg(
        F.min("block").alias("owner"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256")))
    kids = merged.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    merged = merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    leaf, own = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    merged = checkpointed(merged.withColumns({"leaf": leaf, "own": own}))
    placed = opened.select("block", "key").join(merged.select("key", "parent", "depth", "conv_id", "owner", "leaf", "own"), "key")
    mine = F.col("block") == F.col("owner")
    raised = placed.select("block", "key", "parent", "depth", *[F.when(mine, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("leaf", "own")])
    raised = raised.groupBy("block").applyInPandas(risen, "key binary, leaf long, own long").groupBy("key").agg(F.sum("leaf").alias("below"), F.sum("own").alias("under"))
    over = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = merged.join(raised, "key").join(over, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("below")).alias("n_leaves"), (F.col("saved_tokens") + F.col("under")).alias("saved_tokens"), "ends_sha256")
    closed = nodes.filter("not open")
    hanging = closed.filter("parent is not null").drop("parent_conv_id", "key").join(
        placed.select("block", F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), ["block", "parent"])
    every = [x.select(whole.columns) for x in (whole, closed.filter("parent is null"), hanging)]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every[0].unionByName(every[1]).unionByName(every[2]).withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
