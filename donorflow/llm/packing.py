"""Sum-of-squares packing of token sequences into windows of a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorflow.llm import symbols
from donorflow.llm.common import tidy

WINDOW = 2048
OPEN_TOKENS = 8 << 20
CACHE_BYTES = 24 << 20
BLOCK_BYTES = 1 << 20
JOIN = 512


class Encoder:
    """Token ids of many texts by a byte-level `tokenizers` file, encoding each different piece between plain spaces once.

    A cut before a space that stands between two characters that surely are no white space never changes byte-level BPE ids:
    its pattern starts a new piece there. Known pieces are kept by hash in sorted arrays of at most CACHE_BYTES and a block's own, until the task ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)  # a byte-level token has one character for each byte
        self.clear()

    def clear(self) -> None:
        self.names, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    @staticmethod
    def cuts(texts: symbols.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces, among them those of all texts that aren't empty; and the bytes that surely end a non-space."""
        d, n = texts.data, len(texts.data)
        plain = (d > 0x20) & (d < 0x7F)
        lead = (d >= 0xC3) & (d <= 0xDF)  # of two-byte characters, none of them white space
        ends = plain.copy()
        ends[1:] |= lead[:-1]
        cut = np.zeros(n, bool)
        if n > 2:
            cut[1:-1] = (d[1:-1] == 0x20) & ends[:-2] & (plain | lead)[2:]
        cut[texts.begin[:-1][np.diff(texts.begin) > 0]] = True
        return np.flatnonzero(cut), ends

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, joins: np.ndarray, names: np.ndarray) -> None:
        """Encodes pieces; those that `joins` marks stand safely before one another and are encoded many at a time."""
        order = np.argsort(~joins, kind="stable")
        start, end, joins, names = start[order], end[order], joins[order], names[order]
        size = end - start
        stops = np.cumsum(size)
        joined = data[np.repeat(start - (stops - size), size) + np.arange(stops[-1])].tobytes()
        first = np.flatnonzero(~joins | (np.arange(len(joins)) % JOIN == 0))
        edges = np.append(stops[first] - size[first], stops[-1]).tolist()
        found = self.tokenizer.encode_batch_fast([joined[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:], strict=False)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        begin = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
        at = np.searchsorted(begin, np.append(0, stops))
        if begin[-1] != stops[-1] or (begin[at] != np.append(0, stops)).any():
            raise ValueError("the tokenizer isn't a byte-level one")
        names = np.concatenate([self.names, names])
        order = np.argsort(names, kind="stable")
        self.names = names[order]
        self.at = np.concatenate([self.at, len(self.flat) + at[:-1]])[order]
        self.size = np.concatenate([self.size, np.diff(at)])[order]
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: symbols.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the place of the first id of each text (and the end)."""
        start, ends = self.cuts(texts)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        end = np.append(start[1:], len(texts.data))
        unique, first, inverse = np.unique(symbols.byte_rolling(texts.data).of(start, end), return_index=True, return_inverse=True)
        if sum(x.nbytes for x in (self.names, self.at, self.size, self.flat)) > CACHE_BYTES:
            self.clear()
        near = np.searchsorted(self.names, unique)
        new = np.flatnonzero(np.append(self.names, np.uint64(0))[near] != unique) if len(self.names) else np.arange(len(unique))
        if len(new):
            a, b = start[first[new]], end[first[new]]
            self.learn(texts.data, a, b, (texts.data[a] == 0x20) & ends[b - 1], unique[new])
            near = np.searchsorted(self.names, unique)
        at, size = self.at[near][inverse], self.size[near][inverse]
        place = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(at - place[:-1], size) + np.arange(place[-1])], place[np.searchsorted(start, texts.begin)]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Open windows by fill level. A level array counts them; each remainder goes where the sum of squared counts grows least."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next, self.done = window, first_id, []
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.count = np.zeros(window + 1, np.int64)
        self.held = 0

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, total, start, ids in pieces:
            self.done.append((doc, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self.emit([(doc, total, at, ids[at : at + self.window])])
        if rest := total - whole:
            self.place((doc, total, whole, ids[whole:]), rest)

    def place(self, piece: tuple, size: int) -> None:
        c, w = self.count, self.window
        # moving a window from level h to h + size changes the sum of squares by 2 (c[h + size] - c[h] + 1); a full or an empty one isn't counted
        change = 2 * (c[size : w + 1] - c[: w + 1 - size] + 1)
        change[-1] = 1 - 2 * c[w - size]
        change[0] = 1 + 2 * c[size] if size < w else 0
        change[1:][c[1 : w + 1 - size] == 0] = np.iinfo(np.int64).max
        best = change.min()
        level = int(np.flatnonzero(change == best)[-1])  # of equal ones, the fullest
        pieces = self.open[level].pop() if level else []
        if level:
            c[level] -= 1
        pieces.append(piece)
        if level + size == w:
            self.held -= level
            self.emit(pieces)
        else:
            self.held += size
            c[level + size] += 1
            self.open[level + size].append(pieces)

    def close(self) -> None:
        """Fills the open windows up, fullest first, with pieces cut from the emptiest; one window at most stays short."""
        rest = [pieces for level in self.open for pieces in level]  # by fill level
        filled = sum(len(x[3]) for pieces in rest for x in pieces) // self.window
        kept = rest[len(rest) - filled :][::-1]
        givers = [piece for pieces in rest[: len(rest) - filled] for piece in pieces]
        for pieces in [*kept, []]:
            fill = sum(len(x[3]) for x in pieces)
            while givers and fill < self.window:
                doc, total, start, ids = givers.pop()
                take = min(len(ids), self.window - fill)
                pieces.append((doc, total, start, ids[:take]))
                fill += take
                if take < len(ids):
                    givers.append((doc, total, start + take, ids[take:]))
            if pieces:
                self.emit(pieces)
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.held = 0


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) that fill windows of `window` tokens.

    A document's tokens and `end_id` are cut into whole windows and a remainder; each remainder goes online to the fill level
    that minimises the sum of squared counts of open windows. A task closes its open windows by cutting the emptiest ones up,
    so that one window of a task at most needs padding; it also closes them whenever they hold eight million tokens, which
    bounds its memory. Tasks don't exchange rows. `ids` are little-endian 32-bit integers; sequence_id is unique, the task's
    number in its upper bits. `tokenizer` is the path of a `tokenizers` file that every executor has.

    Null and empty texts are one piece with `end_id` alone; repeated rows are packed each; no rows give no pieces. Other
    columns are not read. The input must give the same partitions when a task runs again, as files and checkpoints do.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for block in symbols.blocks(batches, size=BLOCK_BYTES):
            ids, place = encoder.encode(symbols.as_texts(block.column("text")))
            for i, doc in enumerate(block.column("doc_id").to_pylist()):
                packer.add(doc, np.append(ids[place[i] : place[i + 1]], np.uint32(end_id)))
            if packer.held > OPEN_TOKENS:
                packer.close()
            if packer.done:
                yield rows(packer)
        packer.close()
        encoder.clear()
        if packer.done:
            yield rows(packer)

    def rows(packer: Packer) -> pa.RecordBatch:
        doc, start, ids, total, sequence, offset = zip(*packer.done, strict=True)
        packer.done = []
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, kind), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
             pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    rows_in = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    name = rows_in.schema["doc_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
    return rows_in.mapInArrow(tidy(work), f"doc_id {name}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
