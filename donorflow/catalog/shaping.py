"""Set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorflow.catalog.bindings import DONATIONS, DONORS, JOINED, query, r6
from donorflow.functions.metadata import DONATION_VARIABLES
from donorflow.operators import shape


@query("union_results", f"""WITH {JOINED} SELECT don_id, Hb, NULL AS age, 'a' AS "Id" FROM joined WHERE sex = 'male' UNION ALL SELECT don_id, NULL, age, 'b' FROM joined WHERE sex = 'female'""")
def _(t):
    j = t.joined()
    return shape.union_results({"a": j.filter("sex = 'male'").select("don_id", "Hb"), "b": j.filter("sex = 'female'").select("don_id", "age")})


@query("id_intersection", f"WITH {DONATIONS}, {DONORS} SELECT donor FROM donations INTERSECT SELECT donor FROM donors WHERE segment = 'BUILDING'")
def _(t):
    return shape.id_intersection(t.donations(), t.donors().filter("segment = 'BUILDING'"), "donor")


@query("row_difference", f"WITH {DONATIONS} SELECT donor, donat_phleb FROM donations EXCEPT ALL SELECT donor, donat_phleb FROM donations WHERE volume_drawn > 200")
def _(t):
    d = t.donations().select("donor", "donat_phleb", "volume_drawn")
    return shape.row_difference(d.select("donor", "donat_phleb"), d.filter("volume_drawn > 200"))


@query("distinct_donors", f"WITH {DONATIONS} SELECT count(DISTINCT donor) AS donors FROM donations")
def _(t):
    return shape.donor_count(t.donations())


@query("melt_numeric", f"""WITH {JOINED}, x AS (SELECT *, lag(Hb, 2) OVER (PARTITION BY donor ORDER BY date, don_id) AS p2 FROM joined)
SELECT 'Age' AS name, CAST(age AS DOUBLE) AS value FROM x UNION ALL SELECT 'Low hemoglobin', CAST(CAST(Hb_deferral AS INTEGER) AS DOUBLE) FROM x UNION ALL SELECT 'Previous Hb 2', round(p2, 6) FROM x WHERE p2 IS NOT NULL""")
def _(t):
    from donorflow.operators.series import hb_lags

    x = hb_lags(t.joined(), n=2, order=("clock", "don_id"))
    m = shape.melt_numeric(x, ["age", "Hb_deferral", "previous_Hb2"], DONATION_VARIABLES)
    return m.select("name", r6("value").alias("value"))


@query("melt_by_group", f"""WITH {JOINED} SELECT sex AS "Sex", 'age' AS name, CAST(age AS DOUBLE) AS value FROM joined UNION ALL SELECT sex, 'volume_drawn', CAST(volume_drawn AS DOUBLE) FROM joined""")
def _(t):
    j = t.joined()
    frames = {s: j.filter(F.col("sex") == s).select("age", "volume_drawn") for s in ("male", "female")}
    return shape.melt_by_group(frames, ["age", "volume_drawn"])


@query("pivot_results", f"""WITH {DONATIONS} SELECT donor, round(max(Hb) FILTER (donat_phleb = 'K' AND status = '-'), 6) AS "K_-", round(max(Hb) FILTER (donat_phleb = 'H' AND status = 'X'), 6) AS "H_X" FROM donations GROUP BY donor""")
def _(t):
    p = shape.pivot_results(t.donations(), ["donor"], ["donat_phleb", "status"], ["K_-", "H_X"], "Hb")
    return p.select("donor", r6("K_-").alias("K_-"), r6("H_X").alias("H_X"))


@query("grid_expand", """SELECT c_custkey, mtry, node FROM customer, (VALUES (2), (3), (5)) AS a(mtry), (VALUES (1), (5), (10), (20)) AS b(node)""")
def _(t):
    grid = {"mtry": [2, 3, 5], "node": [1, 5, 10, 20]}
    return shape.grid_expand(t.table("customer").select("c_custkey"), grid)


@query("multi_source_bind", f"""WITH {DONATIONS} SELECT 'k' AS run, don_id, Hb FROM donations WHERE donat_phleb = 'K' UNION ALL SELECT 'h', don_id, Hb FROM donations WHERE donat_phleb = 'H'""")
def _(t):
    d = t.donations().select("don_id", "Hb", "donat_phleb")
    return shape.multi_source_bind({"k": d.filter("donat_phleb = 'K'").drop("donat_phleb"), "h": d.filter("donat_phleb = 'H'").drop("donat_phleb")}, "run")
