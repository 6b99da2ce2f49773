"""Deduplication of word sequences by matching statistics against suffix automata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from donorflow.llm import repeats, symbols

GRAM = 8


class SuffixAutomaton:
    """All substrings of a shard of sequences, and how often each state's strings occur."""

    def __init__(self, sequences: list[list[int]]):
        self.ways: list[dict[int, int]] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]
        for s in sequences:
            self._add(s)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def _state(self, size: int, ways: dict[int, int], link: int, count: int) -> int:
        self.ways.append(ways)
        self.size.append(size)
        self.link.append(link)
        self.count.append(count)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings through p, which is shorter."""
        copy = self._state(self.size[p] + 1, dict(self.ways[q]), self.link[q], 0)
        while p >= 0 and self.ways[p].get(c) == q:
            self.ways[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _add(self, sequence: list[int]) -> None:
        last, ways, link, size = 0, self.ways, self.link, self.size
        for c in sequence:
            if c in ways[last]:  # an earlier sequence has it
                q = ways[last][c]
                last = q if size[q] == size[last] + 1 else self._split(last, c, q)
                self.count[last] += 1
                continue
            new, p = self._state(size[last] + 1, {}, 0, 1), last
            while p >= 0 and c not in ways[p]:
                ways[p][c] = new
                p = link[p]
            if p >= 0:
                q = ways[p][c]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
            last = new

    def repeated(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Spans of a sequence of this shard that occur twice or more in the shard: its matching statistics of at least `least`.

        At each word the automaton's state holds all of the sequence so far; the longest suffix that occurs again is that of
        the nearest state up the links that occurs twice.
        """
        spans, v = [], 0
        for i, c in enumerate(sequence, 1):
            v = self.ways[v][c]
            u, n = v, i
            while u > 0 and self.count[u] < 2:
                u = self.link[u]
                n = self.size[u]
            if n >= least:
                if spans and i - n <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], i - n), i)
                else:
                    spans.append((i - n, i))
        return spans


def solve(table: pa.Table, least: int) -> pa.Table:
    """Builds the automaton of each key's segments as reference shard, and streams the segments through it."""
    c = {n: table.column(n).to_numpy() for n in ("key", "k", "h", "start")}
    order = np.lexsort((c["start"], c["h"], c["k"], c["key"]))
    c = {n: x[order] for n, x in c.items()}
    fresh = np.ones(len(order), bool)  # a document that occurs again brings its segments again
    fresh[1:] = np.any([x[1:] != x[:-1] for x in c.values()], axis=0)
    order, c = order[fresh], {n: x[fresh] for n, x in c.items()}
    texts = symbols.as_texts(table.column("symbols").combine_chunks().take(pa.array(order)).cast(pa.large_binary()))
    _, names = np.unique(texts.data.view(np.uint64), return_inverse=True)
    begin, names = texts.begin // 8, names.tolist()
    turns = np.flatnonzero(np.append(True, c["key"][1:] != c["key"][:-1])).tolist()
    out: list[tuple[int, int, int]] = []
    for a, b in zip(turns, [*turns[1:], len(order)], strict=True):
        shard = [names[begin[i] : begin[i + 1]] for i in range(a, b)]
        automaton = SuffixAutomaton(shard)
        out += [(a + j, s, e) for j, sequence in enumerate(shard) for s, e in automaton.repeated(sequence, least)]
    at, start, stop = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
    return pa.table({"k": c["k"][at], "h": c["h"][at], "start": (c["start"][at] + start).astype(np.int32), "stop": (c["start"][at] + stop).astype(np.int32)})


def remove_shared(docs: DataFrame, least: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, removed, kept): each text without the words that a window of `least` words covers whose sequence
    also starts anywhere else, in the same text or another. `removed` lists maximal runs of words (start, stop), `kept` joins
    the other words by one space.

    Each reference shard holds the segments of one window key, and its automaton is sent to the only segments that can
    match it, those of that key: handing every automaton to every document would cost the square of the input. Null texts
    have no words. Rows equal in id and text are one document and get the same result; rows that share an id only are
    different documents. No rows: no rows. Other columns are not read.
    """
    spec = repeats.Windows(window=least, gram=min(GRAM, least), words=True, keep_first=False)
    rows = repeats.identified(docs, text, key)
    spans = repeats.repeated_spans(rows, spec, lambda t: solve(t, least), repeats.SPAN)

    def cut(texts: symbols.Texts, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[pa.Array]:
        w = symbols.words(texts)
        keep = repeats.kept_mask(len(w.start), w.first, owner, start, stop)
        first = np.concatenate([[0], np.cumsum(keep)])[w.first]
        a, b = w.start[keep], w.end[keep]
        size = b - a + 1  # each word and a space
        size[first[1:][np.diff(first) > 0] - 1] -= 1  # none after a text's last word
        ends = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(a - ends[:-1], size) + np.arange(ends[-1])
        data = np.append(texts.data, np.uint8(0x20))[np.minimum(source, len(texts.data))]
        data[np.repeat(b, size) == source] = 0x20
        kept = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends[first].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
        return [pa.array(np.diff(w.first)), repeats.span_lists(len(texts), owner, start, stop), kept]

    return repeats.without_spans(rows, spans, "n_words long, removed array<struct<start:long,stop:long>>, kept string", cut)
