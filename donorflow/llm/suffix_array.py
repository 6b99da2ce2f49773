"""Deduplication of byte strings by the common-prefix interval tree of an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from donorflow.llm import repeats, symbols

GRAM = 24
MIXED = 256  # the symbol left of a segment's start, and of occurrences that differ there


def enhanced_suffix_array(data: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lcp, left symbol) of the suffixes that share `least` bytes with another one, in prefix order.

    Texts are data[begin[i]:begin[i + 1]]. lcp[i] is the common prefix of suffixes i - 1 and i where it is at least `least`,
    else 0. The first `least` bytes are ordered by name (a hash), as any order that keeps equal prefixes together gives the
    same interval tree; the rest is ordered by bytes. Names whose suffixes all have one symbol at the left are left out:
    there the same strings, one symbol longer, begin one place before.
    """
    sizes = np.maximum(np.diff(begin) - least + 1, 0)
    ends = np.cumsum(sizes)
    place = np.repeat(begin[:-1] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    if not len(place):
        return place, place, place
    stop = np.repeat(begin[1:], sizes)
    left = np.where(place > np.repeat(begin[:-1], sizes), data[np.maximum(place - 1, 0)].astype(np.int16), np.int16(MIXED))
    name = symbols.Rolling(symbols.BYTE_VALUES[data]).of(place, place + least)
    order = np.argsort(name)
    fresh = np.ones(len(order), bool)
    fresh[1:] = name[order][1:] != name[order][:-1]
    at = np.flatnonzero(fresh)
    low, high = np.minimum.reduceat(left[order], at), np.maximum.reduceat(left[order], at)
    many = np.diff(np.append(at, len(order)))
    held = np.repeat((many > 1) & ((low != high) | (high == MIXED)), many)
    number = (np.cumsum(fresh) - 1)[held]
    order = order[held]
    place, stop, left = place[order], stop[order], left[order]
    rest = stop - place - least
    width = -(-int(rest.max(initial=0)) // 8) * 8 + 8
    tail = np.concatenate([data, np.zeros(width, np.uint8)])
    span = np.arange(width)
    more = np.where(span < rest[:, None], tail[place[:, None] + least + span], 0).astype(np.uint8)
    keys = more.view(">u8").astype(np.uint64)
    order = np.lexsort((place, rest, *[keys[:, j] for j in range(keys.shape[1] - 1, -1, -1)], number))
    place, left, rest, more, number = place[order], left[order], rest[order], more[order], number[order]
    differ = more[1:] != more[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.zeros(len(place), np.int64)
    lcp[1:] = np.where(number[1:] == number[:-1], least + np.minimum(common, np.minimum(rest[1:], rest[:-1])), 0)
    return place, lcp, left


def maximal_repeats(place: list[int], lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(length, first place, further places) of each maximal repeat of at least `least` symbols.

    One scan with a stack of open prefix intervals. An interval is a maximal repeat if its occurrences have different
    symbols at their left. A place is told once, in the longest repeat where an earlier one exists; the repeats that enclose
    it hold it through their parts: all occurrences of a repeat are its own and those of the intervals inside it.
    """
    stack: list[list] = []  # length, first place, left symbol, further places

    def put(node: list, first: int, symbol: int) -> None:
        if first < node[1]:
            first, node[1] = node[1], first
        node[3].append(first)
        if symbol != node[2]:
            node[2] = MIXED

    for i in range(1, len(place) + 1):
        shared = lcp[i] if i < len(place) else 0
        first, symbol = place[i - 1], left[i - 1]
        while stack and stack[-1][0] > shared:
            node = stack.pop()
            put(node, first, symbol)
            first, symbol = node[1], node[2]
            if symbol == MIXED:
                yield node[0], first, node[3]
        if shared >= least:
            if stack and stack[-1][0] == shared:
                put(stack[-1], first, symbol)
            else:
                stack.append([shared, first, symbol, []])


def solve(table: pa.Table, least: int) -> pa.Table:
    """Maximal repeats of some segments: a row for each occurrence but the first, with the first one's place."""
    c = {n: table.column(n).to_numpy() for n in ("k", "h", "start")}
    order = np.lexsort((c["start"], c["h"], c["k"]))
    c = {n: x[order] for n, x in c.items()}
    fresh = np.ones(len(order), bool)  # a document that occurs again brings its segments again
    fresh[1:] = (c["k"][1:] != c["k"][:-1]) | (c["h"][1:] != c["h"][:-1]) | (c["start"][1:] != c["start"][:-1])
    c = {n: x[fresh] for n, x in c.items()}
    texts = symbols.as_texts(table.column("symbols").combine_chunks().take(pa.array(order[fresh])).cast(pa.large_binary()))
    place, lcp, left = enhanced_suffix_array(texts.data, texts.begin, least)
    length, first, more = [], [], []
    for n, one, further in maximal_repeats(place.tolist(), lcp.tolist(), left.tolist(), least):
        length += [n] * len(further)
        first += [one] * len(further)
        more += further
    length, first, more = (np.array(x, np.int64) for x in (length, first, more))
    a, b = (np.searchsorted(texts.begin, x, side="right") - 1 for x in (more, first))
    start = c["start"][a] + more - texts.begin[a]
    return pa.table({
        "k": c["k"][a], "h": c["h"][a], "start": start.astype(np.int32), "stop": (start + length).astype(np.int32),
        "first_k": c["k"][b], "first_start": (c["start"][b] + first - texts.begin[b]).astype(np.int32),
    })


def remove_repeats(docs: DataFrame, least: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, removed, kept): each text as UTF-8 bytes without those that a string of `least` bytes covers which
    also starts earlier (in a smaller doc_id, or before in the same text). `removed` lists maximal runs (start, stop), `kept`
    holds the other bytes. Matches never cross texts; overlaps count.

    Null texts are empty, null ids come before all others. Rows that share an id are documents in order of a hash of their
    texts; rows equal in both are one document and get the same result. No rows: no rows. Other columns are not read.
    """
    spec = repeats.Windows(window=least, gram=min(GRAM, least), words=False, keep_first=True)
    rows = repeats.identified(docs, text, key)
    spans = repeats.repeated_spans(rows, spec, lambda t: solve(t, least), f"{repeats.SPAN}, first_k long, first_start int")

    def cut(texts: symbols.Texts, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[pa.Array]:
        keep = repeats.kept_mask(len(texts.data), texts.begin, owner, start, stop)
        sizes = repeats.per_text(keep, texts.begin)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        kept = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(texts.data[keep].tobytes())])
        return [pa.array(np.diff(texts.begin)), repeats.span_lists(len(texts), owner, start, stop), kept]

    return repeats.without_spans(rows, spans, "n_bytes long, removed array<struct<start:long,stop:long>>, kept binary", cut)
