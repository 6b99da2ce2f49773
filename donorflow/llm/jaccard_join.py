"""Exact Jaccard self-join of shingle sets by blocked sparse products of the document by n-gram incidence.

1. Counts of n-grams over the whole corpus, in a fixed number of hashed counters, give every n-gram a rank: rare ones first.
2. Sets of a size band that link differ in at most d n-grams, with d from the band's sizes. So the columns of the incidence
   matrix are dealt by hash into d + 1 parts and a few more, c: linked sets agree in more than c whole parts. Each set leaves
   out the c parts whose rarest n-gram is the most frequent, by one order of parts for all sets, so the best part that two
   linked sets agree in is left out by neither. Equal parts name candidates with one row a document (a star, not all
   pairs), and chained stars make blocks of documents outside which no link can exist.
3. Only documents in blocks bring their whole sets. Large blocks are cut by size bands, and into tiles of bounded numbers of n-grams; each tile
   multiplies its sparse incidence rows, dropping pairs by bounds from their sizes, and returns exact link counts and a
   spanning forest.

Documents with equal sets are one class from the start, known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorflow.llm import symbols
from donorflow.llm.common import checkpointed, tidy
from donorflow.llm.components import components, local_stars
from donorflow.llm.repeats import NO_ID, _lists, identified, written

COUNTERS, CHUNK = 1 << 22, 1 << 16
PRODUCT = 500_000  # incidences multiplied at a time
TILE = 2_000_000  # n-grams in the sets of one side of a tile


@lru_cache
def band_edges(percent: int) -> np.ndarray:
    """Sizes where bands start, so that two linked sets lie in one band or in neighbouring ones."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges)


def bands(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The band of each size: linked sets lie in one band or in neighbouring ones."""
    return np.searchsorted(band_edges(percent), sizes, side="right")


def shingle_sets(texts: symbols.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the place of each text's first (and the end).

    Texts with fewer than k words have one shingle of all words, those without words none. A-Z count as a-z.
    """
    w = symbols.words(texts)
    rolling = symbols.Rolling(symbols.byte_rolling(symbols.lower_ascii(texts.data)).of(w.start, w.end))
    sizes = np.diff(w.first)
    many = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(many)), many)
    ends = np.cumsum(many)
    start = np.repeat(w.first[:-1] - (ends - many), many) + np.arange(len(owner))
    hashes = rolling.of(start, np.minimum(start + k, w.first[1:][owner]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.searchsorted(owner[fresh], np.arange(len(many) + 1))


def class_of(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols.mix(sets), dtype=np.uint64)])
    return symbols.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def surveyed(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, k, h, class, size, band) of each document; and in rows of their own (chunk, counts), the task's n-gram counters."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int32)
        for block in symbols.blocks(batches):
            sets, first = shingle_sets(symbols.as_texts(block.column("text")), k)
            np.add.at(counts, (sets & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            n = block.num_rows
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("k"), block.column("h"), pa.array(class_of(sets, first)), pa.array(np.diff(first)), pa.array(bands(np.diff(first), percent)),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32()))], names=names)
        if counts.any():
            for j in range(COUNTERS // CHUNK):
                empty = [pa.nulls(1, t) for t in (kinds[0], pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*empty, pa.array([j], pa.int32()), pa.array([counts[j * CHUNK : (j + 1) * CHUNK]], pa.list_(pa.int32()))], names=names)

    names = ["doc_id", "k", "h", "class", "size", "band", "chunk", "counts"]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]]
    return rows.mapInArrow(tidy(work), f"doc_id {kind}, k long, h int, class long, size long, band long, chunk int, counts array<int>")


def ranks(survey: DataFrame) -> np.ndarray:
    """One byte for each counter, rising with the logarithm of its count: four megabytes, whatever the corpus."""
    counted = survey.filter("chunk is not null").select("chunk", "counts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals[chunk] = totals.get(chunk, 0) + counts.values.to_numpy().astype(np.int64)
        for chunk, counts in totals.items():
            level = np.minimum(np.log2(1 + counts) * 8, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()])], names=["chunk", "levels"])

    out = np.zeros(COUNTERS, np.uint8)
    for chunk, levels in counted.repartition(COUNTERS // CHUNK, "chunk").mapInArrow(tidy(work), "chunk int, levels binary").collect():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(levels, np.uint8)
    return out


def part_keys(sets: np.ndarray, first: np.ndarray, level: np.ndarray, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, owner) of the parts that each set shows in its group, which holds the bands group - 1 and group.

    level: of each n-gram, low for rare ones. Where no two different sets can link, nothing is shown.
    """
    largest = band_edges(percent)[group] - 1
    differ = (100 - percent) * 2 * largest // (100 + percent)
    spare = np.where(differ > 0, differ // 4 + 2, 0)
    many = np.where((differ > 0) & (np.diff(first) > 0), differ + 1 + spare, 0)
    begin = np.cumsum(many) - many
    owner = np.repeat(np.arange(len(many)), np.diff(first))
    dealt = many[owner] > 0
    owner, grams, level = owner[dealt], sets[dealt], level[dealt]
    mixed = symbols.mix(grams ^ np.uint64(0x9E3779B97F4A7C15))
    cell = begin[owner] + (mixed % many[owner].astype(np.uint64)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    at = np.searchsorted(cell[order], np.arange(many.sum() + 1))
    count = np.diff(at)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols.mix(mixed)[order], dtype=np.uint64)])
    rarest = np.full(len(count), 256)
    full = np.flatnonzero(count)
    if len(full):
        rarest[full] = np.minimum.reduceat(level[order], at[full])
    owner = np.repeat(np.arange(len(many)), many)
    part = np.arange(len(owner)) - begin[owner]
    content = symbols.mix(sums[at[1:]] - sums[at[:-1]] + count.astype(np.uint64))
    key = symbols.mix(content ^ symbols.mix((group[owner].astype(np.uint64) << np.uint64(44)) + part.astype(np.uint64)))
    order = np.lexsort((part, count, -rarest, owner))  # each set's weakest parts first, so places in it are places in their order
    shown = order[part >= spare[owner]]
    return key[shown], owner[shown]


def stars(rows: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(a, b): classes of near size that show an equal part, tied in stars by each task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in symbols.blocks(batches):
            sets, first = shingle_sets(symbols.as_texts(block.column("text")), k)
            level = shared.value[(sets & np.uint64(COUNTERS - 1)).astype(np.int64)]
            both = [part_keys(sets, first, level, bands(np.diff(first), percent) + d, percent) for d in (0, 1)]
            key, owner = (np.concatenate(x) for x in zip(*both, strict=True))
            if len(key):
                yield _lists((key % np.uint64(parts)).astype(np.int64), parts, {"key": key.view(np.int64), "node": class_of(sets, first)[owner]})

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        key, node = (table.column(n).combine_chunks().flatten().to_numpy() for n in ("key", "node"))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        least = node[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        root, other = local_stars(least[least != node], node[least != node])
        yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(other)], names=["a", "b"])

    sent = rows.select("text").mapInArrow(tidy(columns), "p int, key array<long>, node array<long>")
    return sent.repartition(parts, "p").mapInArrow(tidy(tie), "a long, b long").distinct()


def _row_sums(marked: np.ndarray, column: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many marked columns each of some rows has: the product of these rows with one vector."""
    many = first[rows + 1] - first[rows]
    ends = np.cumsum(many)
    place = np.repeat(first[rows] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
    hit = np.concatenate([[0], np.cumsum(marked[column[place]])])
    return hit[ends] - hit[ends - many]


def tile_links(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray, home: np.ndarray, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weighted links of each set, a spanning forest of the links) in one tile.

    side: 0 and 1 for the two blocks of documents of a tile between blocks, where only pairs across count; all 2 in a tile of
    one block. home: of the block's own size band; pairs of two others are told elsewhere. Rows of the incidence are ordered from the tile's rarest n-gram; a product of the first columns names
    candidates, whose sizes must allow the similarity, and the full product of the survivors gives exact overlaps.
    """
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    names = np.unique(flat)
    column = np.searchsorted(names, flat).astype(np.int32)
    count = np.bincount(column)
    number = np.empty(len(count), np.int32)
    number[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.int32)
    cells = (np.repeat(np.arange(len(sets)), size) << 32) + number[column]
    cells = np.sort(cells[count[column] > 1])  # an n-gram of one document has no part in any product
    column = (cells & 0xFFFFFFFF).astype(np.int32)
    first = np.searchsorted(cells >> 32, np.arange(len(sets) + 1))
    inside = np.diff(first)
    reach = np.maximum(size + (-percent * size) // 100 + 1 - (size - inside), 0)  # lone n-grams come first
    del flat, names, cells
    holders: dict[int, list[int]] = {}
    links, forest, root = np.zeros(len(sets), np.int64), [], np.arange(len(sets))
    marked = np.zeros(len(count), bool)
    for i in np.argsort(size, kind="stable").tolist():
        mine = column[first[i] : first[i + 1]]
        near: set[int] = set()
        for c in mine[: reach[i]].tolist():
            held = holders.setdefault(c, [])
            near.update(held)
            held.append(i)
        if not near:
            continue
        other = np.fromiter(near, np.int64, len(near))
        other = other[(100 * size[other] >= percent * size[i]) & ((side[other] != side[i]) | (side[i] == 2)) & (home[other] | home[i])]
        if not len(other):
            continue
        marked[mine] = True
        overlap = np.concatenate([_row_sums(marked, column, first, part) for part in np.array_split(other, 1 + inside[other].sum() // PRODUCT)])
        marked[mine] = False
        other = other[100 * overlap >= percent * (size[other] + size[i] - overlap)]
        links[i] += weight[other].sum()
        links[other] += weight[i]
        for r in np.unique(root[other]).tolist():
            if r != root[i]:
                forest.append((i, int(r)))
                root[root == r] = root[i]
    return links, forest


def multiplied(found: DataFrame, percent: int) -> DataFrame:
    """(node, links, other): link counts of classes (other null), and forest edges (links null). found: (block, tiles, ...)."""

    def product(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        node, weight, side, home = (np.array(x) for x in list(zip(*held, strict=True))[:4])
        links, forest = tile_links([x[4] for x in held], weight, side, home, percent)
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.nulls(len(some), pa.int64())], names=["node", "links", "other"])
            left, right = local_stars(*(node[list(x)] for x in zip(*forest, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.nulls(len(left), pa.int64()), pa.array(right)], names=["node", "links", "other"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # rows come sorted, so one tile at a time is held
        for batch in batches:
            block, tile, node, weight, side = (batch.column(n).to_numpy() for n in ("block", "tile", "class", "weight", "side"))
            home = batch.column("home").to_numpy(zero_copy_only=False)
            lists = batch.column("set")
            for i in range(batch.num_rows):
                if (block[i], tile[i]) != at:
                    yield from product(held)
                    at, held = (block[i], tile[i]), []
                if not held or held[-1][0] != node[i]:  # a document that occurs again brings its set again
                    held.append((node[i], weight[i], side[i], home[i], lists[i].values.to_numpy()))
        yield from product(held)

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "block", "tile").sortWithinPartitions("block", "tile", "class").mapInArrow(tidy(work), "node long, links long, other long")


def whole_sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (k, h, class, block, blocks, weight, home) with each document's set, once for each tile of its block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in symbols.blocks(batches):
            sets, first = shingle_sets(symbols.as_texts(block.column("text")), k)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[block.column(n) for n in ("class", "block", "blocks", "weight", "home")], lists], names=["class", "block", "blocks", "weight", "home", "set"])

    found = rows.join(wanted, ["k", "h"]).select("text", "class", "block", "blocks", "weight", "home")
    found = found.mapInArrow(tidy(work), "class long, block long, blocks int, weight long, home boolean, `set` array<long>")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiled = found.select("*", own.alias("own"), other)
    tile = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return tiled.select("block", tile.alias("tile"), "class", "weight", "home", side.cast("int").alias("side"), "set")


def link_similar(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, text_hash, stays) of every document.

    Two documents link when 100 * intersection >= percent * union of their sets of `words`-word shingles, exactly.
    component_id is the smallest doc_id that links lead to, n_links the number of documents linked with this one; `stays` is
    true for one document of each component, the smallest by doc_id and then text_hash (of `identified`). Texts with
    fewer words have one shingle, those without words or null link with nothing and are their own component. Null ids come
    before all others. Rows equal in id and text are one document, given again for each row; rows that share an id only are
    different documents. No rows: no rows. Other columns are not read.
    """
    rows = identified(docs, text, key)
    survey = written(surveyed(rows, words, percent), "survey")
    found = survey.filter("chunk is null").select("doc_id", "k", "h", "class", "size", "band")
    candidates = components(checkpointed(stars(rows, words, percent, ranks(survey))))
    members = found.filter("size > 0").select("k", "h", "class", "size", "band").distinct().groupBy("class").agg(F.min(F.struct("k", "h")).alias("one"), F.count(F.lit(1)).alias("weight"), F.first("size").alias("size"), F.first("band").alias("band"))
    members = checkpointed(members)
    wanted = members.join(candidates.withColumnRenamed("node", "class"), "class")
    wanted = checkpointed(wanted.select(F.col("one.k").alias("k"), F.col("one.h").alias("h"), "class", "weight", "size", "label", "band"))
    whole = wanted.groupBy("label").agg((F.sum("size") <= tile).alias("whole"))  # fits one tile: its bands stay together
    home = F.explode(F.when(F.col("whole"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("home")
    wanted = wanted.join(whole, "label").select("*", home)
    level = F.when(F.col("whole"), 0).when(F.col("home"), F.col("band")).otherwise(F.col("band") + 1)
    wanted = checkpointed(wanted.withColumn("block", F.xxhash64("label", level.cast("long"))))
    sizes = wanted.groupBy("block").agg(F.ceil(F.sum("size") / tile).cast("int").alias("blocks"), F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("home"), 1)).alias("homes"))
    wanted = wanted.join(sizes.filter("homes > 0 and all > 1"), "block").select("k", "h", "class", "block", "blocks", "weight", "home")
    linked = checkpointed(multiplied(whole_sets(rows, wanted, words), percent))
    joined = components(linked.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = linked.filter("links is not null").groupBy(F.col("node").alias("class")).agg(F.sum("links").alias("links"))
    labelled = members.join(joined.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left")
    labelled = labelled.select("class", F.col("one").alias("least"), "weight", F.coalesce("label", "class").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    lowest = labelled.groupBy("label").agg(F.min("least").alias("component"))
    labelled = labelled.join(lowest, "label").select("class", "component", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = found.join(labelled, (found["class"] == labelled["class"]) & (found["size"] > 0), "left")
    alone = F.col("component").isNull()
    component = F.when(alone, F.col("doc_id").cast("long")).otherwise(F.nullif(F.col("component.k"), F.lit(NO_ID)))
    return out.select(
        "doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("h").alias("text_hash"), (alone | ((F.col("component.k") == F.col("k")) & (F.col("component.h") == F.col("h")))).alias("stays"),
    )
