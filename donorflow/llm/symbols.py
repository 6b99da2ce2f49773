"""Vectorised helpers on batches of texts: bytes, words, rolling hashes and window anchors.

All work on one block of whole texts (a few megabytes, or one longer text). Hashes have 64 bits; symbols get random 64-bit
values, so two different strings share a hash with a chance near 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base^0 .. Base^(n-1) and the same of its inverse, modulo 2^64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hashes of any substrings of a sequence of 64-bit symbol values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hash of each run of k symbols, by its start."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


@dataclass
class Texts:
    """A block of texts as one byte array; text i is data[begin[i]:begin[i + 1]]. Nulls are empty."""

    data: np.ndarray
    begin: np.ndarray

    def __len__(self) -> int:
        return len(self.begin) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.begin[i + 1]].tobytes()


def as_texts(column: pa.Array) -> Texts:
    column = column.fill_null("").cast(pa.large_binary())
    begin = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[begin[0] : begin[-1]] if raw is not None else np.zeros(0, np.uint8)
    return Texts(data, begin - begin[0])


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches again, in pieces of about `size` bytes of text; a longer text is a piece of its own."""
    held, weight = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, before + max(size - weight, 1)))
            stop = min(max(stop, at + (not held)), batch.num_rows)
            if stop > at:
                held.append(batch.slice(at, stop - at))
                weight += int(ends[stop - 1] - before)
                at = stop
            if at < batch.num_rows or weight >= size:
                yield _joined(held)
                held, weight = [], 0
    if held:
        yield _joined(held)


def _lengths(column: pa.Array) -> np.ndarray:
    texts = column.fill_null("").cast(pa.large_binary())
    begin = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return np.diff(begin)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


@dataclass
class Words:
    """Words of a block: byte places of each, and the number of the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """Which text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: Texts) -> Words:
    """Maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    data, n = texts.data, len(texts.data)
    inside = np.ones(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_and(data != 0x20, (data - np.uint8(9)) > 4, out=inside[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[texts.begin] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut) & (np.arange(n + 1) < n))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return Words(start, end, np.searchsorted(start, texts.begin))


def byte_rolling(data: np.ndarray) -> Rolling:
    return Rolling(BYTE_VALUES[data])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    upper = (data - np.uint8(65)) < 26
    return data + (upper.astype(np.uint8) << 5)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by the first one's place."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


@dataclass
class Anchors:
    """Runs of window starts whose windows share their least gram; every window start is in exactly one run."""

    key: np.ndarray  # hash of that gram: equal windows have equal keys
    start: np.ndarray  # first symbol of the first window
    count: np.ndarray  # number of window starts
    content: np.ndarray  # hash of all symbols that these windows cover
    twice: np.ndarray  # the least gram occurs again inside, so that two of the windows may be equal


def anchors(values: np.ndarray, begin: np.ndarray, window: int, gram: int) -> Anchors:
    """Cuts the windows of each text (begin: first symbol of each text, and the end) into runs.

    Two equal windows anywhere have the same key, as the least gram depends on the window alone. A run has at most as many
    starts as a window has grams, also where a text repeats one symbol.
    """
    most = window - gram + 1
    none = np.zeros(0, np.int64)
    if len(values) < window:
        return Anchors(none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(bool))
    rolling = Rolling(values)
    grams = mix(rolling.grams(gram))
    key = sliding_minimum(grams, window - gram + 1)
    valid = np.zeros(len(key) + 1, np.int8)
    lengths = np.diff(begin)
    long = lengths >= window
    np.add.at(valid, begin[:-1][long], 1)
    np.add.at(valid, begin[1:][long] - window + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    turn = np.ones(len(key), bool)
    turn[1:] = (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])
    inside = begin[:-1][long]
    turn[inside] = True
    at = np.flatnonzero(turn)
    count = np.diff(np.append(at, len(key)))
    keep = valid[at]
    at, count = at[keep], count[keep]
    if len(count) and count.max() > most:
        pieces = -(-count // most)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, count = np.repeat(at, pieces) + number * most, np.minimum(np.repeat(count, pieces) - number * most, most)
    return Anchors(key[at], at, count, rolling.of(at, at + count - 1 + window), _occurs_again(grams, key[at], at, count + window - gram))


def _occurs_again(grams: np.ndarray, key: np.ndarray, at: np.ndarray, size: np.ndarray, step: int = 16_384) -> np.ndarray:
    """Whether `key` is among grams[at:at + size] more than once."""
    out = np.zeros(len(at), bool)
    for i in range(0, len(at), step):
        many = size[i : i + step]
        ends = np.cumsum(many)
        place = np.repeat(at[i : i + step] - (ends - many), many) + np.arange(ends[-1])
        same = np.flatnonzero(grams[place] == np.repeat(key[i : i + step], many))
        out[i : i + step] = np.diff(np.searchsorted(same, np.append(0, ends))) > 1
    return out
