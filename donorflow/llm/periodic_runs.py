"""Periodic runs of words, found at the boundaries of the nonterminals of a Re-Pair grammar.

1. Inside a run every eight words (a third of the least length) come again a period away, so only stretches whose grams all
   occur twice in their text can hold runs. Everything below works on these stretches, of many texts at a time.
2. Re-Pair in rounds: pairs of neighbouring symbols are ranked by how often they occur, and each pair becomes a new symbol
   wherever no pair beside it ranks higher, until no pair occurs twice. What is left of a stretch is joined two by two.
3. The lowest symbol whose expansion holds a run is cut by it at the boundary of its two children. So each different symbol
   is searched once, at that boundary only, for all periods; hashes and a binary search tell how far a period goes.
4. What was found is moved to all places where the symbol was made; pieces inside a longer interval of the same period go,
   and of several periods of one interval the smallest stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.llm import symbols
from donorflow.llm.common import tidy

LEAST, TIMES = 24, 3
BLOCK_BYTES = 1 << 20
PAIRS = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"
Prepare = Callable[[pa.Array, symbols.Texts], symbols.Texts]
_TEXT = np.uint64(0x9FB21C651E98DF25)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def repeated_stretches(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest stretches all of whose grams occur twice in their text, if a run fits in."""
    k = least // TIMES
    none = np.zeros(0, np.int64)
    if len(values) < least:
        return none, none
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(owner[k - 1 :] == owner[: len(owner) - k + 1])
    key = symbols.mix(symbols.mix(symbols.Rolling(values).grams(k)[whole]) ^ (owner[whole].astype(np.uint64) * _TEXT))
    order = np.argsort(key)
    twin = np.zeros(len(key), bool)
    same = key[order[1:]] == key[order[:-1]]
    twin[order[1:]] = same
    twin[order[:-1]] |= same
    at = whole[twin]
    if not len(at):
        return none, none
    turn = np.flatnonzero((np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])) + 1
    start, end = at[np.append(0, turn)], at[np.append(turn - 1, len(at) - 1)] + k
    long = end - start >= least
    return start[long], end[long]


@dataclass
class Grammar:
    """Symbols of two children each: length of the left one and of both, one place, and all places in order of the symbol."""

    left: np.ndarray
    size: np.ndarray
    node: np.ndarray
    start: np.ndarray

    def place(self) -> np.ndarray:
        return self.start[np.searchsorted(self.node, np.arange(len(self.size)))]


def chosen(rank: np.ndarray) -> np.ndarray:
    """Places to pair up: where the rank is above both neighbours'; of several equal ones in a row every other. Below 0: none."""
    edge = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
    value = rank[edge]
    padded = np.concatenate([[-1], value, [-1]])
    best = (value >= 0) & (value > padded[:-2]) & (value > padded[2:])
    size = np.diff(np.append(edge, len(rank)))[best]
    return ranges(np.zeros(len(size), np.int64), -(-size // 2)) * 2 + np.repeat(edge[best], -(-size // 2))


def grammar(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> Grammar:
    """Re-Pair of the stretches values[start:end]; no symbol crosses a stretch."""
    place = ranges(start, end - start)
    stretch = np.repeat(np.arange(len(start)), end - start)
    symbol = np.unique(values[place], return_inverse=True)[1].astype(np.int64)
    terminals = int(symbol.max()) + 1 if len(symbol) else 0
    sizes, lefts, nodes, starts = [np.ones(terminals, np.int64)], [], [], []
    size, repeats = sizes[0], True
    while len(symbol):
        inside = np.append(stretch[1:] == stretch[:-1], False)
        if not inside.any():
            break
        code = symbol * len(size) + np.append(symbol[1:], 0)
        if repeats:
            found, number, count = np.unique(code[inside], return_inverse=True, return_counts=True)
            rank = np.empty(len(found), np.int64)
            rank[np.lexsort((symbols.mix(found.view(np.uint64)), count))] = np.arange(len(found))
            every = np.full(len(symbol), -1)
            every[inside] = np.where(count > 1, rank, -1)[number]
            at = chosen(every)
            repeats = len(at) > 0
        if not repeats:
            offset = np.arange(len(symbol)) - np.searchsorted(stretch, stretch)
            at = np.flatnonzero(inside & (offset % 2 == 0))
        made, one, number = np.unique(code[at], return_index=True, return_inverse=True)
        one = at[one]
        lefts.append(size[symbol[one]])
        sizes.append(size[symbol[one]] + size[symbol[one + 1]])
        nodes.append(len(size) - terminals + number)
        starts.append(place[at])
        symbol[at] = len(size) + number
        size = np.concatenate([size, sizes[-1]])
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        symbol, place, stretch = symbol[stays], place[stays], stretch[stays]
    if not nodes:
        none = np.zeros(0, np.int64)
        return Grammar(none, none, none, none)
    node, begin = np.concatenate(nodes), np.concatenate(starts)
    order = np.argsort(node, kind="stable")
    return Grammar(np.concatenate(lefts), size[terminals:], node[order], begin[order])


class Common:
    """How far two places of a sequence agree, forwards or backwards, many at a time."""

    def __init__(self, values: np.ndarray):
        self.up, _ = symbols.powers(len(values) + 1)
        self.sums = symbols.Rolling(values).sums

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """values[i:i + size] == values[j:j + size], for i <= j."""
        return (self.sums[i + size] - self.sums[i]) * self.up[j - i] == self.sums[j + size] - self.sums[j]

    def search(self, limit: np.ndarray, same: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros(len(limit), np.int64), limit.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = same(middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def forward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self.search(limit, lambda n: self.same(i, j, n))

    def backward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self.search(limit, lambda n: self.same(i - n, j - n, n))


def crossing_runs(values: np.ndarray, common: Common, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int) -> list[np.ndarray]:
    """(number, start, end, period) of what is periodic in begin:end on both sides of middle, one row for each extent and period."""
    out = []
    many = (end - begin) // TIMES
    stops = np.cumsum(many)
    at = 0
    while at < len(many):
        stop = max(int(np.searchsorted(stops, (stops[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
        i = np.repeat(np.arange(at, stop), many[at:stop])
        q = ranges(np.ones(stop - at, np.int64), many[at:stop])
        b, m, e = begin[i], middle[i], end[i]
        # one period before the boundary lies inside, or one period after it
        for x, y, joined in ((m - q, m, (m - q >= b) & (values[m - q] == values[m])), (m, m + q, (m + q <= e) & (values[m - 1] == values[np.minimum(m + q, e) - 1]))):
            x, y, period, number = x[joined], y[joined], q[joined], i[joined]
            start = x - common.backward(x, y, x - b[joined])
            stop_at = y + common.forward(x, y, e[joined] - y)
            long = (stop_at - start >= np.maximum(least, TIMES * period)) & (start < m[joined]) & (stop_at > m[joined])
            out.append(np.stack([number, start, stop_at, period])[:, long])
        at = stop
    found = np.concatenate(out, 1) if out else np.zeros((4, 0), np.int64)
    found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
    fresh = np.ones(found.shape[1], bool)
    fresh[1:] = (found[:3, 1:] != found[:3, :-1]).any(0)
    return list(found[:, fresh])


def runs_of(values: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs in a block of texts of words, by start and period."""
    none = np.zeros(0, np.int64)
    held = grammar(values, *repeated_stretches(values, first, least))
    wide = np.flatnonzero(held.size >= least)
    if not len(wide):
        return none, none, none
    place = held.place()[wide]
    number, start, end, period = crossing_runs(values, Common(values), place, place + held.left[wide], place + held.size[wide], least)
    node = wide[number]
    a, b = np.searchsorted(held.node, node), np.searchsorted(held.node, node, side="right")
    shift = held.start[ranges(a, b - a)] - np.repeat(place[number], b - a)
    start, end, period = np.repeat(start, b - a) + shift, np.repeat(end, b - a) + shift, np.repeat(period, b - a)
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = np.maximum.accumulate(period * (len(values) + 1) + end) if len(end) else end
    fresh = np.ones(len(end), bool)
    fresh[1:] = period[1:] * (len(values) + 1) + end[1:] > reach[:-1]
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(end), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def joined_words(texts: symbols.Texts, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> symbols.Texts:
    """Texts of the words start:end joined by one space; `first`: number of the first word of each text, and the end."""
    size = end - start + 1
    last = first[1:][np.diff(first) > 0] - 1
    size[last] -= 1  # no space behind the last word
    stops = np.concatenate([[0], np.cumsum(size)])
    place = ranges(start, size)
    space = np.setdiff1d(stops[1:] - 1, stops[last + 1] - 1)
    data = texts.data[np.minimum(place, len(texts.data) - 1)] if len(place) else np.zeros(0, np.uint8)
    data[space] = 0x20
    return symbols.Texts(data, stops[first])


def looped(ids: pa.Array, texts: symbols.Texts) -> symbols.Texts:
    """The words of each text joined by one space; every tenth document, by crc32 of its id, goes round in a loop from some word on.

    With h the crc32 of the decimal id (null: of nothing) and g its tenth, h % 10 == 0 makes each word i >= a the word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    w = symbols.words(texts)
    index = np.arange(len(w.start))
    for i, doc in enumerate(ids.to_pylist()):
        h = zlib.crc32(b"" if doc is None else str(doc).encode())
        n, g = int(w.first[i + 1] - w.first[i]), h // 10
        if h % 10 == 0 and n:
            a = g % n
            index[w.first[i] + a : w.first[i + 1]] = w.first[i] + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return joined_words(texts, w.start[index], w.end[index], w.first)


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, prepare: Prepare | None = None) -> DataFrame:
    """(doc_id, n_words, runs, kept): all runs of each text by start and period, and the text with one period left of each.

    Words are runs of characters other than ASCII white space. A run is a stretch of words with smallest period q, at least
    max(least, 3 q) long, that no neighbouring word extends; start, length and period count words. `kept` holds the words
    that no run contains after its first period, joined by one space. `prepare` may change a block's texts beforehand.

    Nothing is shuffled: each task reads whole texts, a megabyte or one longer text at a time. Null and empty texts have no
    words and no runs, and an empty `kept`; repeated rows are searched each; no rows give no rows. Other columns are not read.
    Equality of words and phrases is that of 64-bit hashes.
    """
    if least < 3 * TIMES:
        raise ValueError("least must be 9 words or more")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in symbols.blocks(batches, size=BLOCK_BYTES):
            ids, texts = block.column("doc_id"), symbols.as_texts(block.column("text"))
            if prepare:
                texts = prepare(ids, texts)
            w = symbols.words(texts)
            start, end, period = runs_of(symbols.byte_rolling(texts.data).of(w.start, w.end), w.first, least)
            gone = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, end, -1)
            stays = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            kept = joined_words(texts, w.start[stays], w.end[stays], np.searchsorted(stays, w.first))
            begin = np.searchsorted(start, w.first)
            owner = np.repeat(np.arange(len(texts)), np.diff(begin))
            fields = [pa.array(x) for x in (start - w.first[owner], end - start, period)]
            runs = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
            whole = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(kept.begin.astype(np.int64)), pa.py_buffer(kept.data))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(w.first)), runs, whole.cast(pa.string())], names=["doc_id", "n_words", "runs", "kept"])

    return rows.mapInArrow(tidy(work), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, kept string")


def steepest(runs: str = "runs") -> Column:
    """The run with the greatest length by period, exactly; of equal ones the first by start, then period. None: null."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: F.when(better(best, x), x).otherwise(best))
