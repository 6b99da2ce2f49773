"""Splits, samples and class balance.

A seeded MD5 picks the subjects, so SQL can name them too: every query returns its members.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from donorflow.catalog.bindings import DONATIONS, DONORS, JOINED, query, r6
from donorflow.operators import sampling
from donorflow.session import reliable_checkpoint

ORDER = ("clock", "don_id")


def ranked(seed, key, by=""):
    """SQL of the place of a key in the order that a seeded hash gives."""
    return f"row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY md5('{seed}|' || {key}), {key})"


def members(df, *columns):
    return df.select(*columns, "donor").distinct()


@query("split_three_way", f"""WITH {DONATIONS}, d AS (SELECT DISTINCT donor FROM donations), r AS (SELECT donor, {ranked(42, 'donor')} AS i, count(*) OVER () AS n FROM d)
SELECT CASE WHEN i <= floor(0.64::DOUBLE * n) THEN 'train' WHEN i <= floor(0.64::DOUBLE * n) + floor(0.16::DOUBLE * n) THEN 'validate' ELSE 'test' END AS label, donor FROM r""")
def _(t):
    return members(sampling.split_three_way(t.donations(), "donor", 42), "label")


@query("split_mode", f"""WITH {JOINED} SELECT 'initial' AS mode, don_id, CASE label WHEN 'train' THEN 'train' ELSE 'test' END AS split FROM joined WHERE label <> 'test'
UNION ALL SELECT 'final', don_id, CASE label WHEN 'test' THEN 'test' ELSE 'train' END FROM joined""")
def _(t):
    j = t.joined().select("don_id", "label")
    parts = [sampling.split_mode(j, m).select(F.lit(m).alias("mode"), "don_id", "split") for m in ("initial", "final")]
    return parts[0].unionByName(parts[1])


_STRATA = f"""{DONATIONS}, l AS (SELECT donor, count(*) AS n FROM donations GROUP BY donor),
q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b, quantile_cont(n, 0.75) AS c FROM l),
s AS (SELECT donor, CAST(n > a AS INTEGER) + CAST(n > b AS INTEGER) + CAST(n > c AS INTEGER) AS stratum FROM l, q),
k AS (SELECT stratum, count(*) AS n FROM s GROUP BY stratum)"""


@query("split_two_way", f"WITH {_STRATA} SELECT CASE WHEN {ranked(3, 'donor', 'stratum')} <= ceil(0.8::DOUBLE * count(*) OVER (PARTITION BY stratum)) THEN 'train' ELSE 'test' END AS split, donor FROM s")
def _(t):
    return members(sampling.split_two_way(t.donations(), "donor", 0.8, 3), "split")


@query("kfold_by_donor", f"WITH {_STRATA} SELECT CAST(({ranked(5, 'donor', 'stratum')} + stratum) % 4 AS INTEGER) AS fold, donor FROM s")
def _(t):
    return members(sampling.kfold_by_donor(t.donations(), "donor", 4, 5), "fold")


@query("sample_donors", f"""WITH {DONORS}, r AS (SELECT donor, {ranked(9, 'donor')} AS i, count(*) OVER () AS n FROM (SELECT DISTINCT donor FROM donors))
SELECT 'share' AS kind, donor FROM r WHERE i <= floor(0.3::DOUBLE * n) UNION ALL SELECT 'number', donor FROM r WHERE i <= 40""")
def _(t):
    d, p = t.donations(), t.donors()
    parts = [sampling.sample_donors(d, p, a, 9, "donor")[1].select(F.lit(k).alias("kind"), "donor") for k, a in (("share", 0.3), ("number", 40))]
    return members(parts[0].unionByName(parts[1]), "kind")


@query("stratified_sample", f"""WITH {JOINED}, d AS (SELECT DISTINCT donor, label, sex FROM joined),
r AS (SELECT *, {ranked(11, 'donor', 'label, sex')} AS i, count(*) OVER (PARTITION BY label, sex) AS n FROM d)
SELECT 'share' AS kind, label, sex, donor FROM r WHERE i <= floor(0.5::DOUBLE * n)
UNION ALL SELECT 'number', label, sex, donor FROM r WHERE i <= CASE label WHEN 'train' THEN 38 WHEN 'validate' THEN 9 ELSE 13 END""")
def _(t):
    j = t.joined().select("donor", "label", "sex")
    parts = [sampling.stratified_sample(j, True, s, 11).withColumn("kind", F.lit(k)) for k, s in (("share", 0.5), ("number", 60))]
    return members(parts[0].unionByName(parts[1]), "kind", "label", "sex")


def _balance_sql(base, target, seed):
    ratio = f"({1 - target}::DOUBLE / {target}::DOUBLE)"
    return f"""e AS (SELECT donor, bool_or(Hb_deferral) AS ever FROM {base} GROUP BY donor), c AS (SELECT count(*) FILTER (ever) AS s, count(*) FILTER (NOT ever) AS n FROM e),
b AS (SELECT CASE WHEN floor(s * {ratio}) <= n THEN s ELSE floor(n / {ratio}) END AS s, CASE WHEN floor(s * {ratio}) <= n THEN floor(s * {ratio}) ELSE n END AS n FROM c),
r AS (SELECT donor, ever, {ranked(seed, 'donor', 'ever')} AS i FROM e)
SELECT ever, donor FROM r, b WHERE i <= CASE WHEN ever THEN s ELSE b.n END"""


def ever_members(df):
    return df.groupBy("donor").agg(F.max("Hb_deferral").alias("ever")).select("ever", "donor")


@query("balance_classes", f"WITH {JOINED}, {_balance_sql('joined', 0.5, 13)}")
def _(t):
    return ever_members(sampling.balance_classes(t.joined(), 0.5, 13))


_TRIM = f"""{JOINED}, x AS (SELECT *, count(*) OVER (PARTITION BY donor) AS cnt, sum(CAST(Hb_deferral AS INTEGER)) OVER (PARTITION BY donor) AS hits, first_value(Hb_deferral) OVER (PARTITION BY donor ORDER BY date, don_id) AS f FROM joined),
trimmed AS (SELECT * FROM x WHERE cnt > 1 AND NOT (hits = 1 AND f))"""


@query("enrich", f"WITH {_TRIM}, {_balance_sql('trimmed', 0.4, 17)}")
def _(t):
    return ever_members(sampling.enrich(t.joined(), 0.4, 17, order=ORDER))


@query("upsample_minority", f"""WITH {JOINED}, n AS (SELECT count(*) FILTER (Hb_deferral) AS a, count(*) FILTER (NOT Hb_deferral) AS b FROM joined),
r AS (SELECT Hb_deferral, don_id, {ranked(19, 'don_id', 'Hb_deferral')} AS i FROM joined),
c AS (SELECT r.*, CASE WHEN Hb_deferral THEN a ELSE b END AS mine, greatest(a, b) AS most FROM r, n)
SELECT Hb_deferral, don_id, CAST(CASE WHEN mine = most THEN 1 ELSE most // mine + CAST(i <= most % mine AS INTEGER) END AS BIGINT) AS n FROM c""")
def _(t):
    return sampling.upsample_minority(t.joined(), "Hb_deferral", 19, "don_id").groupBy("Hb_deferral", "don_id").agg(F.count(F.lit(1)).alias("n"))


_AXES = ["age", "volume_drawn", "acctbal"]
_GAP = "sqrt(" + " + ".join(f"(p.{a} - q.{a}) * (p.{a} - q.{a})" for a in _AXES) + ")"
_DRAW = "((CAST('0x' || substr(md5('23|{0}|' || key || '|' || copy), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)"


@query("smote", f"""WITH {JOINED}, b AS (SELECT don_id AS key, Hb_deferral, {', '.join(f'CAST({a} AS DOUBLE) AS {a}' for a in _AXES)} FROM joined),
m AS (SELECT * FROM b WHERE Hb_deferral), full_rows AS (SELECT * FROM m WHERE {' AND '.join(f'{a} IS NOT NULL' for a in _AXES)}),
near AS (SELECT p.key, q.key AS neighbor, {_GAP} AS d, {', '.join(f'q.{a} AS to_{a}' for a in _AXES)} FROM full_rows p JOIN full_rows q ON p.key <> q.key
 QUALIFY row_number() OVER (PARTITION BY p.key ORDER BY d, q.key) <= 5),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, neighbor) AS place, count(*) OVER (PARTITION BY key) AS found FROM near),
r AS (SELECT f.*, {ranked(23, 'f.key')} AS i, count(*) OVER () AS base FROM full_rows f WHERE key IN (SELECT key FROM near)),
need AS (SELECT (SELECT count(*) FROM b WHERE NOT Hb_deferral) - (SELECT count(*) FROM m) AS n),
c AS (SELECT r.*, unnest(range(1, CAST(n // base + CAST(i <= n % base AS INTEGER) AS BIGINT) + 1)) AS copy FROM r, need),
s AS (SELECT c.*, CAST(floor({_DRAW.format('which')} * found) AS BIGINT) + 1 AS pick, {_DRAW.format('share')} AS u FROM c JOIN (SELECT DISTINCT key, found FROM placed) USING (key))
SELECT key AS don_id, CAST(place AS INTEGER) AS place, neighbor, round(d, 6) AS distance, NULL::BOOLEAN AS "Hb_deferral", NULL::BOOLEAN AS synthetic, {', '.join(f'NULL::DOUBLE AS {a}' for a in _AXES)} FROM placed
UNION ALL SELECT NULL, NULL, NULL, NULL, Hb_deferral, FALSE, {', '.join(f'round({a}, 6)' for a in _AXES)} FROM b
UNION ALL SELECT NULL, NULL, NULL, NULL, TRUE, TRUE, {', '.join(f'round(s.{a} + u * (to_{a} - s.{a}), 6)' for a in _AXES)} FROM s JOIN placed ON s.key = placed.key AND s.pick = placed.place""")
def _(t):
    """Every minority row's exact neighbors, and all real and synthetic rows."""
    j = t.joined().select("don_id", "Hb_deferral", *_AXES)
    near = reliable_checkpoint(sampling.nearest_neighbors(j.filter("Hb_deferral"), _AXES, "don_id", 5))
    out = sampling.smote(j, _AXES, "Hb_deferral", "don_id", seed=23, near=near)
    made = out.select("Hb_deferral", "synthetic", *[r6(a).alias(a) for a in _AXES])
    pairs = near.select(F.col("key").alias("don_id"), F.posexplode("near").alias("i", "n")).select(
        "don_id", (F.col("i") + 1).alias("place"), F.col("n.key").alias("neighbor"), r6("n.d").alias("distance"))
    return pairs.unionByName(made, allowMissingColumns=True)


@query("class_weights", f"""WITH {JOINED} SELECT don_id, round(1 - count(*) OVER (PARTITION BY Hb_deferral) / count(*) OVER (), 6) AS weight FROM joined""")
def _(t):
    return sampling.class_weights(t.joined(), "Hb_deferral").select("don_id", r6("weight").alias("weight"))


@query("permute_rows", f"WITH {DONATIONS} SELECT don_id, donor FROM donations")
def _(t):
    return sampling.permute_rows(t.donations().select("don_id", "donor"), 29, ["don_id"])
