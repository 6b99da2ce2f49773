"""The trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorflow.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs):
    """convs: id to list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(set)
    for key in members:
        if key:
            children[key[:-1]].add(key)

    def below(key):
        return [key] + [y for x in children[key] for y in below(x)]

    out = []
    for key, who in members.items():
        under = below(key)
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()
        out.append((min(who), len(key), min(members[key[:-1]]) if key else None, len(who), len(children[key]), sum(not children[k] for k in under), saved, digest))
    return sorted(out, key=repr)


def talks(seed, count, twist=0):
    r = random.Random(seed)
    rows = []
    for c in range(count):
        c = c * 7 - 40 * twist
        if r.random() < 0.3:
            turns = [("user", "hello"), ("assistant", "é" * 3)] * r.choice([1, 2])
        else:
            turns = [(r.choice(["user", "system", None]), r.choice(["a", "bb", "", None, "ccc"])) for _ in range(r.randint(1, 7))]
        rows += [(c, None if i == 0 and r.random() < 0.2 else i, role, text) for i, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    return rows


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda x: (-1 if x[1] is None else x[1])):
        if c is not None:
            convs[c].append((role or "", text or ""))
    return convs


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    return df.withColumns({c: F.lit(1) for c in ("turns", "id", "size", "key", "block", "name", "ids")})


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(x) for x in df.collect()), key=repr)


@pytest.mark.parametrize("block", [1, 5, 40, 100_000])
def test_trie_equals_brute_force(spark, block):
    rows = talks(block, 150) + [(None, 1, "user", "x")] + [(5000, i, "user", "long " * 50) for i in range(300)] + [(5001, i, "user", "long " * 50) for i in range(200)]
    got = found(prefix_trie.trie(prefix_trie.sequences(frame(spark, rows)), block))
    assert got == brute(in_order(rows))


@pytest.mark.parametrize("block", [9, 100_000])
def test_rebuilt(spark, block):
    rows = talks(3, 90) + [(100 * i, j, "user", f"head {i % 2}") for i in range(4, 9) for j in range(i - 3)]
    rows += [(c, 0, "user", "only") for c in range(901, 921)]  # turnless where h > 0 and conversation 900 is missing
    convs = in_order(rows)
    want = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not x for x in want.values())
    got = found(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(frame(spark, rows))), block))
    assert got == brute(want)


def test_empty_and_single(spark):
    none = prefix_trie.sequences(frame(spark, []))
    assert found(prefix_trie.trie(none)) == []
    one = prefix_trie.sequences(frame(spark, [(3, 0, None, None)]))
    assert found(prefix_trie.trie(one)) == brute({3: [("", "")]})


def test_copies_fill_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("one")).otherwise(F.concat(F.lit("x"), F.col("id") % 7)).cast("binary").alias("name"), F.col("id").alias("conv_id"))
    got = {bytes(r.name): r.ends_sha256 for r in prefix_trie.ends_digests(df).collect()}
    want = defaultdict(list)
    for i in range(3000):
        want[b"one" if i % 3 == 0 else b"x%d" % (i % 7)].append(str(i))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_forest_merges_in_descending_depth():
    f = prefix_trie.Forest(np.array([2, 3, 3, 1]), np.array([2, 2, 0]))
    # the first sequence is the prefix of the next two; the root joins it with the last
    assert f.parent == [4, 0, 0, 4, -1] and f.depth == [2, 3, 3, 1, 0]
