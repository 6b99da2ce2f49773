"""Repeated windows of symbols across all documents: who else holds each window, without shuffling texts more than needed.

Every window of `window` symbols is assigned to the least `gram` hash inside it, so equal windows anywhere have the same key.
Consecutive windows with one key form a segment. Three shuffles follow:

1. (key, hash of the segment's content, place). Equal segments are settled by their hashes; tasks send each content once for
   each block of texts, so a passage in a third of all documents comes to a reducer once a block.
2. Segments whose key other segments with different content have, too: their symbols are fetched and meet by key.
3. The settled spans return to their documents.

Around a line that many texts share, every text brings its own content under one key. Segments of keys with more than HEAVY
contents don't meet as a whole: one of each content is cut again by a longer gram, and its pieces go the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorflow.llm import symbols
from donorflow.llm.common import tidy
from donorflow.session import shared_folder

NO_ID = -(1 << 63)
SPAN = "k long, h int, start int, stop int"


@dataclass(frozen=True)
class Windows:
    """window and gram count symbols: bytes or words. keep_first: the first holder of a window keeps it."""

    window: int
    gram: int
    words: bool
    keep_first: bool

    def read(self, texts: symbols.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Symbol values of a block, and the first symbol of each text (and the end)."""
        if not self.words:
            return texts.data, texts.begin
        found = symbols.words(texts)
        return symbols.byte_rolling(texts.data).of(found.start, found.end), found.first

    def held(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that hold their symbols as bytes."""
        texts = symbols.as_texts(column.cast(pa.large_binary()))
        return (texts.data.view(np.uint64), texts.begin // 8) if self.words else (texts.data, texts.begin)

    def spread(self, values: np.ndarray) -> np.ndarray:
        return values if self.words else symbols.BYTE_VALUES[values]


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, and its lineage cut."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/donorflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, text, k, h): documents in order of k, then h. Rows with equal id and text are one document that occurs again."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return rows.withColumns({"k": k, "h": F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")})


def merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans of each owner."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order].astype(np.int64), start[order].astype(np.int64), stop[order].astype(np.int64)
    reach = np.maximum.accumulate((owner << 32) + stop)
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] << 32) + start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return owner[at], start[at], reach[np.append(at[1:], len(owner)) - 1] & 0xFFFFFFFF


def _lists(part: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each part, holding its items as lists."""
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part, minlength=parts)
    used = np.flatnonzero(sizes)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[used])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *lists], names=["p", *columns])


_ITEMS = {"key": np.int64, "content": np.int64, "k": np.int64, "h": np.int32, "start": np.int32, "count": np.int32, "at": np.int32}
SPAN_KEY = 0  # a span travels as an item with this `content`; `key` is free
HOT_KEY = 1  # tells that a block has sent this key's segments apart, by their contents
MANY, TWICE, HOT = 1 << 16, 1 << 17, 1 << 18  # seen more than once in its block of texts; windows inside may be equal; sent apart
HEAVY = 1024  # contents of a key that may meet in one group
BLOCK_CONTENTS = 16  # contents of a key that a block of texts sends to the key's own task
GROUP_BYTES = 16 << 20  # symbols of whole keys that are solved at once


def segments(rows: DataFrame, spec: Windows, parts: int) -> DataFrame:
    """Lists of segments for each part, from whole texts (k, h, text), or from pieces of texts (k, h, start, symbols).

    `count` may hold the flags MANY, TWICE and HOT; `at` is where the piece starts. content 0: a settled span, its end in
    `count`; 1: a key whose segments are HOT in some block.
    """
    apart = BLOCK_CONTENTS
    whole = "text" in rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in symbols.blocks(batches, "text" if whole else "symbols"):
            if whole:
                values, begin = spec.read(symbols.as_texts(block.column("text")))
                base = np.zeros(block.num_rows, np.int64)
            else:
                values, begin = spec.held(block.column("symbols"))
                base = block.column("start").to_numpy().astype(np.int64)
            a = symbols.anchors(spec.spread(values), begin, spec.window, spec.gram)
            if not len(a.key):
                continue
            k, h = block.column("k").to_numpy(), block.column("h").to_numpy()
            doc = np.searchsorted(begin, a.start, side="right") - 1
            start = a.start - begin[doc] + base[doc]
            by = np.lexsort((h, k))
            fresh = np.ones(len(by), bool)
            fresh[1:] = (k[by][1:] != k[by][:-1]) | (h[by][1:] != h[by][:-1])
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(fresh) - 1
            place = (rank[doc] << 32) + start
            content = np.where(a.content <= HOT_KEY, 2, a.content)
            order = np.lexsort((place, symbols.mix(a.key ^ symbols.mix(content))))
            lead = np.ones(len(order), bool)
            lead[1:] = (a.key[order][1:] != a.key[order][:-1]) | (content[order][1:] != content[order][:-1])
            group = np.cumsum(lead) - 1
            first = order[lead]
            other = place[order] != place[first][group]
            again = order[other]
            many = np.bincount(group[other], minlength=len(first)) > 0
            count = a.count[first]
            sent = {"key": a.key[first].view(np.int64), "content": content[first].view(np.int64), "k": k[doc[first]], "h": h[doc[first]], "start": start[first], "count": count | many * MANY | a.twice[first] * TWICE, "at": base[doc[first]]}
            part = (a.key[first] % np.uint64(parts)).astype(np.int64)
            names, number, contents = np.unique(a.key[first], return_inverse=True, return_counts=True)
            hot = contents[number] > apart
            if hot.any():
                sent["count"] = sent["count"] | hot * HOT
                part[hot] = (symbols.mix(a.key[first][hot] ^ symbols.mix(content[first][hot])) % np.uint64(parts)).astype(np.int64)
                told = names[contents > apart]
                none = np.zeros(len(told), np.int64)
                marks = {"key": told.view(np.int64), "content": none + HOT_KEY, "k": none, "h": none, "start": none, "count": none, "at": none}
                sent = {c: np.concatenate([sent[c], marks[c].astype(sent[c].dtype)]) for c in sent}
                part = np.concatenate([part, (told % np.uint64(parts)).astype(np.int64)])
            if len(again):
                owner, left, right = merged(doc[again], start[again], start[again] + a.count[again] - 1 + spec.window)
                spans = {"key": np.zeros(len(owner)), "content": np.full(len(owner), SPAN_KEY), "k": k[owner], "h": h[owner], "start": left, "count": right, "at": np.zeros(len(owner))}
                sent = {c: np.concatenate([sent[c], spans[c].astype(sent[c].dtype)]) for c in sent}
                part = np.concatenate([part, (symbols.mix(k[owner]) % np.uint64(parts)).astype(np.int64)])
            yield _lists(part, parts, {c: sent[c].astype(t) for c, t in _ITEMS.items()})

    kinds = ", ".join(f"`{c}` array<{'long' if t is np.int64 else 'int'}>" for c, t in _ITEMS.items())
    return rows.select("k", "h", *(["text"] if whole else ["start", "symbols"])).mapInArrow(tidy(work), f"p int, {kinds}")


def settled(sent: DataFrame, spec: Windows) -> DataFrame:
    """(key, heavy, at, k, h, start, stop): spans that equal segments settle (key null), and segments that may share windows: their key has other contents, too, or they repeat inside. heavy: the key has too many contents to meet in one group."""
    most = HEAVY

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        c = {name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False) for name in _ITEMS}
        is_span = c["content"] == SPAN_KEY
        out = [(c["k"][is_span], c["h"][is_span], c["start"][is_span], c["count"][is_span], None, None, None)]
        is_mark = c["content"] == HOT_KEY
        hot_keys = np.unique(c["key"][is_mark])
        c = {name: x[~is_span & ~is_mark] for name, x in c.items()}
        order = np.lexsort((c["start"], c["h"], c["k"], c["content"], c["key"]))
        c = {name: x[order] for name, x in c.items()}
        n = len(order)
        if n:
            flags, size = c["count"], c["count"] & (MANY - 1)
            hot = (flags & HOT > 0) | np.isin(c["key"], hot_keys)
            new_key, lead, other = np.ones(n, bool), np.ones(n, bool), np.zeros(n, bool)
            new_key[1:] = c["key"][1:] != c["key"][:-1]
            lead[1:] = new_key[1:] | (c["content"][1:] != c["content"][:-1])
            group, at = np.cumsum(lead) - 1, np.flatnonzero(lead)
            for name in ("k", "h", "start"):
                other |= c[name] != c[name][at][group]
            if not spec.keep_first:
                other = (np.bincount(group[other | (flags & MANY > 0)], minlength=len(at)) > 0)[group]
            stop = c["start"] + size - 1 + spec.window
            out.append((c["k"][other], c["h"][other], c["start"][other], stop[other], None, None, None))
            contents = np.bincount((np.cumsum(new_key) - 1)[lead])
            # a key that is hot in one block only has its segments in several tasks; the mark makes all of them heavy
            hot = np.logical_or.reduceat(hot, at)
            chosen = np.repeat(contents > 1, contents) | (flags[at] & TWICE > 0) | hot
            heavy, rivals = (np.repeat(contents > most, contents) | hot)[chosen], at[chosen]
            out.append((c["k"][rivals], c["h"][rivals], c["start"][rivals], stop[rivals], c["key"][rivals], heavy, c["at"][rivals]))
        for k, h, start, stop, key, heavy, at in out:
            if len(k):
                keys = pa.array(key) if key is not None else pa.nulls(len(k), pa.int64())
                heavies = pa.array(heavy) if heavy is not None else pa.nulls(len(k), pa.bool_())
                places = pa.array(at) if at is not None else pa.nulls(len(k), pa.int32())
                yield pa.RecordBatch.from_arrays([keys, heavies, places, pa.array(k), pa.array(h), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["key", "heavy", "at", "k", "h", "start", "stop"])

    return sent.mapInArrow(tidy(work), f"key long, heavy boolean, at int, {SPAN}")


def fetched(rows: DataFrame, wanted: DataFrame, spec: Windows) -> DataFrame:
    """(key, heavy, k, h, start, symbols) of the wanted segments."""
    asked = wanted.groupBy("k", "h").agg(F.collect_list(F.struct("key", "start", "stop", "heavy")).alias("asked"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in symbols.blocks(batches):
            values, begin = spec.read(symbols.as_texts(block.column("text")))
            lists = block.column("asked")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            start, stop = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            size = stop - start
            ends = np.cumsum(size)
            taken = values[np.repeat(begin[owner] + start - (ends - size), size) + np.arange(ends[-1])]
            offsets = np.concatenate([[0], ends * taken.itemsize]).astype(np.int32)
            payload = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(taken.tobytes())])
            k, h = block.column("k").to_numpy()[owner], block.column("h").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([flat.field(0), flat.field(3), pa.array(k), pa.array(h), pa.array(start.astype(np.int32)), payload], names=["key", "heavy", "k", "h", "start", "symbols"])

    return rows.join(asked, ["k", "h"]).select("k", "h", "text", "asked").mapInArrow(tidy(work), "key long, heavy boolean, k long, h int, start int, symbols binary")


Solver = Callable[[pa.Table], pa.Table]


def solved(held: DataFrame, parts: int, solve: Solver, columns: str) -> DataFrame:
    """Spans of `columns` from segments that meet by key; a task solves some whole keys at a time."""
    most = GROUP_BYTES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, weight, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            if weight >= most:  # the open key may go on in this batch
                turn = 0 if keys[0] != last else int(np.append(np.flatnonzero(keys != last), len(keys))[0])
                if turn < len(keys):
                    yield from solve(pa.Table.from_batches([*got, batch.slice(0, turn)])).combine_chunks().to_batches()
                    got, weight, batch = [], 0, batch.slice(turn)
            got.append(batch)
            weight += batch.nbytes
            last = keys[-1]
        if got:
            yield from solve(pa.Table.from_batches(got)).combine_chunks().to_batches()

    return held.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(work), columns)


def pieces_of(held: DataFrame, wanted: DataFrame, spec: Windows) -> DataFrame:
    """(key, heavy, k, h, start, symbols) of wanted segments, out of the pieces (k, h, start, symbols) they lie in."""
    width = 8 if spec.words else 1
    whole = held.dropDuplicates(["k", "h", "start"]).withColumnRenamed("start", "at")
    cut = F.expr(f"substring(symbols, (start - at) * {width} + 1, (stop - start) * {width})")
    return wanted.join(whole, ["k", "h", "at"]).select("key", "heavy", "k", "h", "start", cut.alias("symbols"))


def repeated_spans(rows: DataFrame, spec: Windows, solve: Solver, columns: str) -> DataFrame:
    """Spans (k, h, start, stop, ...) to remove. rows: of identified(). solve: from the segments of some keys to spans of `columns`.

    Segments of keys with too many contents to meet are cut once more, by a longer gram, which tells apart what lies beside a
    common line: their pieces go the same way. The last gram is the window itself, whose keys have one content each.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source, out = rows, []
    for gram in sorted({spec.gram, min(4 * spec.gram, spec.window), spec.window}):
        level = replace(spec, gram=gram)
        first = written(settled(segments(source, level, parts).repartition(parts, "p"), level), "segments")
        out.append(first.filter("key is null").drop("key", "heavy", "at"))
        wanted = first.filter("key is not null")
        rivals = fetched(rows, wanted, spec) if source is rows else pieces_of(source, wanted, spec)
        any_heavy = not first.filter("heavy").isEmpty()
        if any_heavy:
            rivals = written(rivals, "rivals")  # read twice, but texts are shuffled once
        out.append(solved(rivals.filter("not heavy").drop("heavy"), parts, solve, columns))
        if not any_heavy:
            break
        source = rivals.filter("heavy").select("k", "h", "start", "symbols")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def without_spans(rows: DataFrame, spans: DataFrame, columns: str, cut: Callable[[symbols.Texts, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """(doc_id, columns) of every row; cut: from texts and the merged spans of each to the columns."""
    held = spans.groupBy("k", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in symbols.blocks(batches):
            lists = block.column("spans")
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten()
            start, stop = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            owner, start, stop = merged(np.repeat(np.arange(len(lists)), sizes), start, stop)
            made = cut(symbols.as_texts(block.column("text")), owner, start, stop)
            names = ["doc_id", *[x.split()[0] for x in columns.split(", ")]]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *made], names=names)

    return rows.join(held, ["k", "h"], "left").select("doc_id", "text", "spans").mapInArrow(tidy(work), f"doc_id {kind}, {columns}")


def kept_mask(size: int, begin: np.ndarray, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """False for the symbols of a block that a span covers."""
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, begin[owner] + start, 1)
    np.add.at(edges, begin[owner] + stop, -1)
    return np.cumsum(edges[:-1]) == 0


def per_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[begin[1:]] - sums[begin[:-1]]


def span_lists(count: int, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64))], names=["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)
