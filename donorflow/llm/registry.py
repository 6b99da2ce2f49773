"""The queries of this package, one for each operator, and SQL that checks those which SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorflow.llm import block_knn, host_quality, jaccard_join, link_graph, mixing, packing, periodic_runs, pii, prefix_trie, sharding, suffix_array, suffix_automaton, toxicity

QUERIES, SQL = {}, {}
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def removed_size(spans: str = "removed"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])


@query("op1_suffix_array")
def _(spark, sf_dir):
    cut = suffix_array.remove_repeats(table(spark, sf_dir, "documents"), 100)
    return cut.select("doc_id", "n_bytes", removed_size().alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_shard_shuffle")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shuffle_into_shards(light)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_disclosure")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.sanitise(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base_spans", "term_spans"))
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.span_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), pii.span_text(every).alias("spans"))


@query("op4_host_quality", r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS parts FROM d),
g AS (SELECT doc_id, i, words[i:i + 2] AS gram FROM w, unnest(range(1, len(words) - 1)) AS t(i) WHERE len(words) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM w, unnest(parts) AS t(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT w.doc_id, w.source, len(words) AS n_words, coalesce(list_sum([length(x) FOR x IN words]), 0)::BIGINT AS word_chars,
 len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
 FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS failed FROM b GROUP BY source),
m AS (SELECT count(*) AS k, sum(n) AS n, sum(failed) / sum(n) AS mean, sum(n * n) AS squares FROM h),
s AS (SELECT any_value(m.mean) AS mean, (sum(h.n * pow(failed / h.n - m.mean, 2)) - any_value(m.mean * (1 - m.mean) * (k - 1))) / greatest(any_value(m.n - squares / m.n - (k - 1)), 1e-9) AS v FROM h, m),
r AS (SELECT source, CASE WHEN v <= 0 OR mean IN (0, 1) THEN mean WHEN v >= mean * (1 - mean) THEN failed / n
 ELSE (failed + (mean * (1 - mean) / v - 1) * mean) / (n + mean * (1 - mean) / v - 1) END AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.8 AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return host_quality.judge(docs).select("doc_id", *host_quality.FEATURES, "base_failed", "kept")


@query("op5_jaccard_join")
def _(spark, sf_dir):
    return jaccard_join.link_similar(table(spark, sf_dir, "documents"), words=3, percent=90).drop("text_hash", "stays")


@query("op6_sum_of_squares_packing")
def _(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_FIT = " UNION ALL ".join(
    f"SELECT page_id, '{h + p}' AS rule, '{v}' AS verdict FROM u WHERE (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')" for v, h, p in RULES
)


@query("op7_trust_propagation", f"""
WITH r AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM ({_FIT}) GROUP BY page_id),
j AS (SELECT u.*, f.rule, f.ruled FROM u LEFT JOIN f USING (page_id)),
seeds AS (SELECT host, (2 * count(*) FILTER (ruled = 'allow') > count(*))::INT AS a, (2 * count(*) FILTER (ruled = 'block') > count(*))::INT AS b FROM j WHERE host <> '' GROUP BY host),
crossing AS (SELECT count(*) AS n FROM u, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS t(link))
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN seeds.b = 1 AND seeds.a = 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN seeds ON j.host = seeds.host
WHERE (SELECT n FROM crossing) = 0""")
def _(spark, sf_dir):
    return link_graph.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op8_mix_sources", r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w FROM d GROUP BY source),
t AS (SELECT sum(source_size) AS total FROM s),
x AS (SELECT source, source_size, w, 2.0::DOUBLE * source_size AS top, 2.0::DOUBLE * source_size / w AS bend FROM s),
l AS (SELECT a.source, a.bend, (1.5::DOUBLE * (SELECT total FROM t) - coalesce(sum(b.top) FILTER (b.bend < a.bend), 0)) / sum(b.w) FILTER (b.bend >= a.bend) AS level FROM x a, x b GROUP BY a.source, a.bend),
q AS (SELECT min(level) AS level FROM (SELECT level FROM l WHERE level <= bend ORDER BY bend LIMIT 1)),
g AS (SELECT source, source_size, least(top, level * w) AS target FROM x, q),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate,
 ('0x' || substr(md5('8|' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM c""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("words"))
    mixed = mixing.mix_sources(docs, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op9_suffix_automata")
def _(spark, sf_dir):
    cut = suffix_automaton.remove_shared(table(spark, sf_dir, "documents"), 35)
    return cut.select("doc_id", "n_words", removed_size().alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op10_block_neighbours", """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""")
def _(spark, sf_dir):
    return block_knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op11_toxic_lexicon")
def _(spark, sf_dir):
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.judge(docs, labels, learn_from=remainder != 0).select("doc_id", (remainder == 0).alias("held_out"), "score", "predicted")


_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split({0}, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


@query("op12_prefix_trie", f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC32.format('conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
k AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS size, md5(string_agg(md5(length(role) || ':' || role || text), ',') OVER w) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
p AS (SELECT conv_id, 0 AS depth, 0 AS size, '' AS key, NULL AS parent FROM c UNION ALL SELECT conv_id, depth, size, key, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) FROM k),
l AS (SELECT conv_id, arg_max(key, depth) AS key FROM p GROUP BY conv_id),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM l GROUP BY key),
n AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, any_value(size) AS size, count(*) AS n FROM p GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS m FROM n WHERE parent IS NOT NULL GROUP BY parent),
pairs AS (SELECT DISTINCT a.key AS up, b.key FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
s AS (SELECT up, sum((n - 1) * size)::BIGINT AS saved, count(*) FILTER (m IS NULL) AS leaves FROM pairs JOIN n USING (key) LEFT JOIN kids USING (key) GROUP BY up)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(m, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.up = n.key LEFT JOIN kids USING (key) LEFT JOIN n o ON o.key = n.parent LEFT JOIN e ON e.key = n.key""")
def _(spark, sf_dir):
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


@query("op13_periodic_runs")
def _(spark, sf_dir):
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), prepare=periodic_runs.looped).withColumn("best", periodic_runs.steepest())
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))
