"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorflow.catalog.bindings import DONATIONS, DONORS, JOINED, query, r6
from donorflow.functions.metadata import variable_table
from donorflow.operators import joins, series


@query("common_donor_reduce", f"""WITH {DONATIONS}, {DONORS}, d2 AS (SELECT * FROM donations WHERE donor % 4 <> 1), p2 AS (SELECT * FROM donors WHERE donor % 3 <> 0)
SELECT 'donations' AS side, don_id AS id FROM d2 WHERE donor IN (SELECT donor FROM p2) UNION ALL SELECT 'donors', donor FROM p2 WHERE donor IN (SELECT donor FROM d2)""")
def _(t):
    a, b = joins.common_donor_reduce(t.donations().filter("donor % 4 <> 1"), t.donors().filter("donor % 3 <> 0"))
    return a.select(F.lit("donations").alias("side"), F.col("don_id").alias("id")).unionByName(b.select(F.lit("donors").alias("side"), F.col("donor").alias("id")))


@query("donation_donor_join", f"WITH {JOINED} SELECT don_id, donor, label, dob FROM joined")
def _(t):
    return joins.donation_donor_join(t.donations(), t.donors()).select("don_id", "donor", "label", "dob")


@query("semi_join_sample", f"WITH {JOINED} SELECT don_id FROM joined WHERE label = 'validate'")
def _(t):
    return joins.semi_join_sample(t.donations(), t.donors().filter("label = 'validate'")).select("don_id")


@query("in_list_filter", f"WITH {DONATIONS}, {DONORS} SELECT don_id, Hb FROM donations WHERE donor IN (SELECT donor FROM donors WHERE segment = 'MACHINERY')")
def _(t):
    return joins.in_list_filter(t.donations(), t.donors().filter("segment = 'MACHINERY'")).select("don_id", "Hb")


@query("anti_join_last_event", f"""WITH {DONATIONS}, {DONORS}, l AS (SELECT donor, max(dateonly) AS day FROM donations GROUP BY donor), p AS (SELECT donor, CASE WHEN donor % 2 = 0 THEN (SELECT day FROM l WHERE l.donor = donors.donor) ELSE FERRITIN_LAST_DATE END AS ref FROM donors)
SELECT donor, ref FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.donor = p.donor AND l.day = p.ref)""")
def _(t):
    last = t.donations().groupBy("donor").agg(F.max("dateonly").alias("dateonly"))
    dim = t.donors().join(last, "donor", "left").select("donor", F.when(F.col("donor") % 2 == 0, F.col("dateonly")).otherwise(F.col("FERRITIN_LAST_DATE")).alias("ref"))
    return joins.anti_join_last_event(dim, last, [("donor", "donor"), ("ref", "dateonly")])


@query("donor_specific_extract", f"""WITH {DONATIONS}, {DONORS}, l AS (SELECT donor, max(dateonly) AS day FROM donations GROUP BY donor)
SELECT 'first' AS mode, donor, FERRITIN_FIRST AS f FROM donors WHERE FERRITIN_FIRST IS NOT NULL AND donor IN (SELECT donor FROM donations)
UNION ALL SELECT 'all', p.donor, FERRITIN_FIRST FROM donors p JOIN l ON l.donor = p.donor WHERE FERRITIN_FIRST IS NOT NULL AND FERRITIN_LAST IS NOT NULL AND FERRITIN_LAST_DATE <> l.day""")
def _(t):
    d, p = t.donations(), t.donors()
    one = joins.donor_specific_extract(p, d, True).select(F.lit("first").alias("mode"), "donor", F.col("FERRITIN_FIRST").alias("f"))
    return one.unionByName(joins.donor_specific_extract(p, d, False).select(F.lit("all").alias("mode"), "donor", F.col("FERRITIN_FIRST").alias("f")))


@query("attach_donor_variables", f"WITH {JOINED} SELECT don_id, acctbal, segment FROM joined WHERE FERRITIN_FIRST IS NOT NULL")
def _(t):
    dim = t.donors().filter("FERRITIN_FIRST IS NOT NULL").select("donor", "acctbal", "segment")
    return joins.attach_donor_variables(t.donations(), dim).select("don_id", "acctbal", "segment")


@query("attach_metadata", """SELECT p_partkey, v AS "Variable", CASE v WHEN 'Hb' THEN 'Hemoglobin' WHEN 'age' THEN 'Age' WHEN 'hour' THEN 'Hour' END AS "Pretty"
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Hb' WHEN 1 THEN 'age' WHEN 2 THEN 'hour' ELSE 'unknown' END AS v FROM part)""")
def _(t):
    names = F.array(*[F.lit(n) for n in ("Hb", "age", "hour", "unknown")])
    rows = t.table("part").select("p_partkey", F.get(names, (F.col("p_partkey") % 4).cast("int")).alias("Variable"))
    return joins.attach_metadata(rows, variable_table(t.spark)).select("p_partkey", "Variable", "Pretty")


@query("composite_key_join", f"""WITH {JOINED}, b AS (SELECT donor, dateonly, Hb, sex, age, Hb_deferral, volume_drawn FROM joined WHERE don_id % 2 = 0)
SELECT a.don_id, b.volume_drawn FROM joined a JOIN b ON a.donor = b.donor AND a.dateonly = b.dateonly AND a.Hb = b.Hb AND a.sex = b.sex AND a.age = b.age AND a.Hb_deferral = b.Hb_deferral""")
def _(t):
    keys = ["donor", "dateonly", "Hb", "sex", "age", "Hb_deferral"]
    j = t.joined()
    return joins.composite_key_join(j.select("don_id", *keys), j.filter("don_id % 2 = 0").select(*keys, "volume_drawn"), keys).select("don_id", "volume_drawn")


@query("full_outer_append", f"""WITH {DONATIONS}, a AS (SELECT don_id, donor, Hb FROM donations WHERE don_id % 3 <> 0), b AS (SELECT don_id, donor, volume_drawn FROM donations WHERE don_id % 3 <> 1)
SELECT coalesce(a.don_id, b.don_id) AS don_id, coalesce(a.donor, b.donor) AS donor, Hb, volume_drawn FROM a FULL JOIN b ON a.don_id = b.don_id AND a.donor = b.donor""")
def _(t):
    d = t.donations()
    return joins.full_outer_append(d.filter("don_id % 3 <> 0").select("don_id", "donor", "Hb"), d.filter("don_id % 3 <> 1").select("don_id", "donor", "volume_drawn"))


@query("next_event_after", f"""WITH {DONATIONS}, {DONORS}, x AS (SELECT d.don_id, d.donor, d.dateonly FROM donations d JOIN donors p ON d.donor = p.donor WHERE d.dateonly > p.FERRITIN_LAST_DATE)
SELECT don_id FROM x QUALIFY dateonly = min(dateonly) OVER (PARTITION BY donor)""")
def _(t):
    ref = t.donors().select("donor", F.col("FERRITIN_LAST_DATE").alias("ref"))
    return joins.next_event_after(t.donations(), ref).select("don_id")


_FB = "(donat_phleb = 'K' AND status = '-') OR (donat_phleb = 'K' AND status <> '-' AND volume_drawn > 100) OR (donat_phleb = 'H' AND volume_drawn > 100)"


@query("asof_previous_full_blood", f"""WITH {DONATIONS}
SELECT a.don_id, CAST(a.dateonly - max(b.dateonly) AS INTEGER) AS days FROM donations a LEFT JOIN (SELECT donor, dateonly FROM donations WHERE {_FB}) b ON a.donor = b.donor AND b.dateonly < a.dateonly GROUP BY a.don_id, a.dateonly""")
def _(t):
    return joins.asof_previous_full_blood(t.donations(), series.full_blood()).select("don_id", "days")


@query("calendar_range_count", f"""WITH {JOINED}
SELECT a.don_id, count(b.don_id) AS n FROM joined a LEFT JOIN (SELECT donor, dateonly, don_id FROM joined WHERE Hb_deferral) b
  ON a.donor = b.donor AND b.dateonly < a.dateonly AND b.dateonly > a.dateonly - INTERVAL 24 MONTH GROUP BY a.don_id""")
def _(t):
    return joins.calendar_range_count(t.joined(), "Hb_deferral").select("don_id", "n")


@query("last_ferritin_before_last", f"WITH {JOINED} SELECT don_id FROM joined QUALIFY FERRITIN_LAST_DATE < max(dateonly) OVER (PARTITION BY donor)")
def _(t):
    return joins.last_ferritin_before_last(t.joined().join(t.donors().select("donor", F.col("FERRITIN_LAST_DATE").alias("ref")), "donor"), "ref").select("don_id")


@query("frame_diff", """SELECT a.doc_id, a.quality IS DISTINCT FROM b.quality AS quality, a.toxic IS DISTINCT FROM b.toxic AS toxic
FROM labels a JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS quality, 1 - toxic AS toxic FROM labels) b ON a.doc_id = b.doc_id""")
def _(t):
    a = t.table("labels")
    b = a.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("quality")).alias("quality"), (1 - F.col("toxic")).alias("toxic"))
    return joins.frame_diff(a, b, "doc_id")


@query("frame_merge_common", """SELECT doc_id, quality, toxic AS "toxic.x", 1 - toxic AS "toxic.y" FROM labels""")
def _(t):
    a = t.table("labels")
    return joins.frame_merge_common(a, a.withColumn("toxic", 1 - F.col("toxic")), "doc_id")


@query("result_diff", f"""WITH {DONATIONS} SELECT donor, donat_phleb, round(min(Hb), 6) AS value_x, round(max(Hb), 6) AS value_y, round(max(Hb) - min(Hb), 6) AS diff FROM donations GROUP BY donor, donat_phleb""")
def _(t):
    g = t.donations().groupBy("donor", "donat_phleb")
    out = joins.result_diff(g.agg(F.min("Hb").alias("value")), g.agg(F.max("Hb").alias("value")), ["donor", "donat_phleb"])
    return out.select("donor", "donat_phleb", *[r6(c).alias(c) for c in ("value_x", "value_y", "diff")])


