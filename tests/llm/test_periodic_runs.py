"""Periodic runs against a search of every period, word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorflow.llm import periodic_runs, registry, symbols

WORD = "[^\x20\x09-\x0D]+"


def brute(words, least):
    """(start, period, end) of all runs, by looking along every period."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in out.items())


def without(words, runs):
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(r):
    w = []
    for _ in range(r.randint(0, 8)):
        kind = r.random()
        if kind < 0.5:
            base = [r.choice("abc") for _ in range(r.randint(1, r.choice([3, 12, 30])))]
            w += (base * 12)[: r.randint(1, len(base) * 8)]
        elif kind < 0.7:
            w += [r.choice("ab") for _ in range(r.randint(0, 30))]
        elif kind < 0.8 and w:
            w += w[-r.randint(1, len(w)) :] * r.randint(1, 3)
        else:
            w += [r.choice(["d", "é", "f", "gg", "h"]) for _ in range(r.randint(0, 30))]
    return w[:600]


@pytest.mark.parametrize("least", [9, 12, 24])
def test_runs_equal_brute_force(spark, least):
    r = random.Random(least)
    words = [periodic(r) for _ in range(150)] + [["a"] * 3000, [str(i % 700) for i in range(2500)], ["a"] * (least - 1), ["x", "y"] * least]
    rows = [(i, r.choice([" ", "\n", " \t "]).join(w)) for i, w in enumerate(words)] + [(1000, None), (1001, ""), (1002, " \n "), (None, "a " * 50), (5, " ".join(words[5]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("runs", "kept", "row", "n_words", "start")})
    got = periodic_runs.find_runs(df, least=least).collect()
    assert len(got) == len(rows)
    for x in got:
        w = words[x.doc_id] if x.doc_id is not None and x.doc_id < 1000 else ["a"] * 50 if x.doc_id is None else []
        want = brute(w, least)
        assert [(y.start, y.period, y.start + y.length) for y in x.runs] == want
        assert x.n_words == len(w) and x.kept == without(w, want)
    assert periodic_runs.find_runs(df.limit(0)).collect() == []


def test_each_symbol_is_searched_once():
    """A loop of 64 words a thousand times: few symbols, and all intervals come from their boundaries."""
    values = symbols.mix(np.tile(np.arange(64, dtype=np.uint64), 1000))
    held = periodic_runs.grammar(values, np.array([0]), np.array([len(values)]))
    assert len(held.size) < 64 * 4 and held.size.max() == 64000
    for node, start in zip(held.node, held.start):  # every place of a symbol has the same words
        one = held.place()[node]
        assert (values[start : start + held.size[node]] == values[one : one + held.size[node]]).all()
    assert [x.tolist() for x in periodic_runs.runs_of(values, np.array([0, len(values)]))] == [[0], [64000], [64]]


def test_query(spark, folder):
    got = {x.doc_id: x for x in registry.QUERIES["op13_periodic_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = re.findall(WORD, d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue  # the search of every period is quadratic; the longest ones are left to the shorter ones' proof
        runs = brute(w, 24)
        x = got[d.doc_id]
        best = max(runs, key=lambda r: (Fraction(r[2] - r[0], r[1]), -r[0], -r[1]), default=None)
        assert (x.start, x.length, x.period) == ((best[0], best[2] - best[0], best[1]) if best else (None, None, None))
        assert x.exponent_milli == (1000 * x.length // x.period if best else None) and x.n_runs == len(runs)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, q, e in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(without(w, runs).encode()).hexdigest()
