"""Sharding, link graph, neighbours, the registry and the pipeline."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import check
import corpus_pipeline
from donorflow.llm import block_knn, link_graph, registry, sharding


def test_shards_are_exact_and_uniform(spark):
    rows = [(i, f"t{i % 7}", i % 3, None) for i in range(20000)] + [(None, None, None, "x")] * 5003
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, id string").repartition(7)
    got = sharding.shuffle_into_shards(df).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    # where a row was says nothing about its shard or slot
    mean = [np.mean([r.shard for r in got if r.doc_id is not None and r.doc_id % 2 == p]) for p in (0, 1)]
    assert abs(mean[0] - mean[1]) < 0.25
    slots = np.array([(r.doc_id, r.slot) for r in got if r.doc_id is not None])
    assert abs(np.corrcoef(slots.T)[0, 1]) < 0.03


def test_shards_of_few_rows_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    got = sharding.shuffle_into_shards(spark.range(1000)).collect()
    assert Counter(r.shard for r in got) == Counter({s: 62 + (s < 8) for s in range(16)})
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(62 + (s < 8))) for s in range(16))
    assert sharding.shuffle_into_shards(spark.range(0)).collect() == []
    assert len(sharding.shuffle_into_shards(spark.range(3)).collect()) == 3


def test_hypergeometric_draws():
    rng = np.random.default_rng(1)
    big = [sharding.draw_good(rng, 6 * 10**9, 3 * 10**9, 900) for _ in range(3000)]
    assert abs(np.mean(big) - 600) < 1.5 and abs(np.std(big) - 200**0.5) < 1
    assert sharding.draw_good(rng, 10**10, 0, 7) == 7 and sharding.draw_good(rng, 0, 10**10, 7) == 0
    matrix = sharding.communication_matrix([5, 0, 11, 100], 3, 9)
    assert matrix.sum(1).tolist() == [5, 0, 11, 100] and sorted(matrix.sum(0)) == [38, 39, 39]


def test_propagation_against_dense_iteration(spark):
    r = random.Random(3)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(a, b): r.randint(1, 4) for a in hosts[:9] for b in hosts if a != b and r.random() < 0.3}
    t0, b0 = np.zeros(12), np.zeros(12)
    t0[[0, 1]], b0[[2]] = 0.5, 1.0
    w = np.zeros((12, 12))
    for (a, b), n in edges.items():
        w[hosts.index(a), hosts.index(b)] = n
    out, into = w.sum(1, keepdims=True), w.sum(0, keepdims=True)
    ahead, back = np.divide(w, out, where=out > 0, out=np.zeros_like(w)), np.divide(w, into, where=into > 0, out=np.zeros_like(w))
    t, b = t0.copy(), b0.copy()
    for _ in range(200):
        t = 0.15 * t0 + 0.85 * (ahead.T @ t + t[out[:, 0] == 0].sum() * t0)
        b = 0.15 * b0 + 0.85 * (back @ b + b[into[0] == 0].sum() * b0)
    seeds = spark.createDataFrame([(h, float(x), float(y)) for h, x, y in zip(hosts, t0, b0)], "host string, trusted double, blocked double")
    got = link_graph.propagate(spark.createDataFrame([(x, y, n) for (x, y), n in edges.items()], "source string, target string, n long"), seeds, rounds=60, least=1e-9)
    for row in got.collect():
        i = hosts.index(row.host)
        assert row.trust == pytest.approx(t[i], abs=1e-4) and row.distrust == pytest.approx(b[i], abs=1e-4)


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # some hundred small rounds
    pages = [(i, f"x://h{i}.org/", f'<a href="x://h{i - 1}.org/">' if i else None) for i in range(36)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    try:
        got = {r.page_id: (r.verdict, r.distrust) for r in link_graph.judge_urls(df.coalesce(1), [("block", "h0.org", "/")]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: ("block", 1.0) for i in range(36)}


def test_urls(spark):
    link = lambda *urls: "".join(f'<a href="{u}">x</a>' for u in urls)
    pages = [
        (1, "HTTP://Spam.NET/es/a?x#y", link("http://far.org/1"), 0), (2, "http://spam.net/es/b", None, 0), (3, "http://spam.net/de/c", "", 0),
        (4, "http://liar.org/x", link("https://SPAM.net/q", "/rel", "//spam.net/z"), 0), (5, "http://far.org", link("http://good.com/"), 0), (6, None, None, 0),
        (7, "no scheme", "<a href=x>", 0), (8, "x://www.example.com/en/1", link("http://far.org/"), 0), (9, "x://m.example.com/en/1", "", 0), (10, "x://example.com?en", "", 0), (10, "x://example.com?en", "", 0),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_graph.judge_urls(df, registry.RULES).collect()}
    assert got[1] == ("spam.net", "/es/a", "net/es/", "block") and got[3] == ("spam.net", "/de/c", None, "block")
    assert got[4][3] == "block"  # it links to a blocked host
    assert got[5] == ("far.org", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("www.example.com/en/", "allow") and got[9][2:] == ("example.com/en/", "block") and got[10] == ("example.com", "", None, "allow")
    assert link_graph.judge_urls(df.limit(0), registry.RULES).collect() == []


@pytest.mark.parametrize("candidates,queries", [(16384, 4096), (50, 7)])
def test_neighbours(spark, candidates, queries):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], None) for i, v in enumerate(rng.normal(size=(400, 24)) * rng.choice([1e-3, 1, 1e4], size=(400, 1)))]
    rows += [(400 + i, rows[i][1], None) for i in range(40)] + [rows[7], rows[7]]
    rows += [(600, None, 1), (700, [0.0] * 24, 1), (800, [float("nan")] * 24, 1), (900, [None] * 24, 1), (1000, [1.0, 2.0], 1), (None, [1.0] * 24, 1), (1001, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = block_knn.nearest(df, F.col("vec_id") % 20 == 0, candidates=candidates, queries=queries).collect()
    held = {i: np.array(v) for i, v, _ in rows[:440]}
    want = {}
    for q in (i for i in held if i % 20 == 0):
        best = sorted((float(np.sqrt(np.square(held[q] - v).sum())), i) for i, v in held.items() if i != q)[:10]
        want |= {(q, rank + 1): (i, d) for rank, (d, i) in enumerate(best)}
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {k: v[0] for k, v in want.items()}
    assert all(r.score == pytest.approx(want[r.query_id, r["rank"]][1], rel=1e-12) for r in got)
    assert block_knn.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_hold_for_quantised_tiles():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(50, 1500)), rng.normal(size=(300, 1500)) * 100
    (q, qs, qe), (r, rs, re) = block_knn.quantised(a), block_knn.quantised(b)
    assert (block_knn.int8_product(q, r) == q.astype(int) @ r.astype(int).T).all()
    near = np.sqrt(np.square(q * qs[:, None])[:, None].sum(2) + np.square(r * rs[:, None])[None].sum(2) - 2 * qs[:, None] * rs * block_knn.int8_product(q, r))
    true = np.sqrt(np.square(a[:, None] - b[None]).sum(2))
    assert (np.abs(near - true) <= qe[:, None] + re + 1e-6).all()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df, found = registry.QUERIES[name](spark, folder), con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(names, found.fetchall())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] < 1000 and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    assert not docs.filter(F.col("text").rlike("[a-z0-9]@[a-z0-9]+[.][a-z]")).count()
    tokens = corpus_pipeline.run(spark, folder).agg(F.sum("length"), F.count(F.lit(1))).first()
    direct = corpus_pipeline.packed_windows(spark, docs, folder).agg(F.sum("length")).first()
    assert tokens[0] == direct[0] and tokens[1]


def test_pipeline_with_odd_rows_against_plain_python(spark, tmp_path):
    """All five stages on rows with nulls, copies, values and clashing names, beside a plain version of what each has to do."""
    words = [f"word{i}" for i in range(400)]
    clean = lambda i, n=80: " ".join(words[(i * 37 + j * j) % 400] for j in range(n))
    rows = [(i, clean(i), "en", "a" if i % 2 else "b", None) for i in range(30)]
    rows += [(100, clean(3) + " extra", "en", "a", 1), (101, clean(3), "en", "b", 1), (102, None, "en", None, None), (103, "", None, "a", None), (104, "too short", "en", "a", None)]
    rows += [(105, "same same same " * 60, "en", "b", None), (106, clean(7, 120) + " write to anna@example.org now", "en", "a", None), (5, clean(5), "en", "a", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ("row", "_id", "_h", "sanitised", "copies", "size", "kept", "hash", "times")
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("mine") for c in extra})
    stages = dict(corpus_pipeline.STAGES)

    def after(name, df):
        out = spark.createDataFrame(stages[name](spark, df, "").collect(), df.schema)
        assert out.columns == df.columns and {tuple(r) for r in out.select(*extra).distinct().collect()} <= {("mine",) * len(extra)}
        return out

    def failed(text):
        w = (text or "").split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        return len(w) < 50 or 100 * len(again) > 50 * len(w)

    good = after("quality rules", docs)
    want = sorted(r[0] for r in rows if not failed(r[1]))
    assert sorted(r.doc_id for r in good.collect()) == want
    sets = {}
    for r in good.collect():
        w = r.text.split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    stay = [i for i in sorted(sets) if not any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)]
    single = after("near duplicates", good)
    assert sorted(r.doc_id for r in single.collect()) == stay and 100 not in stay and 101 not in stay and stay.count(5) == 1
    safe = after("private data", single)
    texts = {r.doc_id: r for r in safe.collect()}
    assert sorted(texts) == stay and "anna@" not in texts[106].text and "[EMAIL]" in texts[106].text and texts[106].n_chars == len(texts[106].text)
    assert all(texts[r.doc_id].text == r.text for r in single.collect() if r.doc_id != 106)
    mixed = after("mixing", safe)
    sizes = {i: len(r.text.split()) for i, r in texts.items()}
    total = sum(sizes.values())
    by = {s: sum(sizes[i] for i, r in texts.items() if r.source == s) for s in ("a", "b")}
    targets = {"a": min(2 * by["a"], 1.5 * total * 5 / 7)}
    targets["b"] = min(2 * by["b"], 1.5 * total - targets["a"])
    taken = {i: sum(r.doc_id == i for r in mixed.collect()) for i in stay}
    for i, n in taken.items():
        rate = targets[texts[i].source] / by[texts[i].source]
        assert n in (int(rate + 1e-9), int(rate + 1e-9) + 1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    pieces = stages["packing"](spark, mixed, "").collect()
    want = sum(n * (len(tokenizer.encode(texts[i].text, add_special_tokens=False).ids) + 1) for i, n in taken.items())
    assert sum(r.length for r in pieces) == want
    docs.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in ran if r.start == 0) == sorted((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []
