"""Descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorflow.catalog.bindings import DONATIONS, JOINED, SCORES, query, r6
from donorflow.operators import describe

ORDER = ("clock", "don_id")


@query("donor_max_deferral", f"""WITH {JOINED}, d AS (SELECT donor, count(*) AS n, count(*) FILTER (Hb_deferral) AS hits FROM joined GROUP BY donor)
SELECT count(*) AS donors, count(*) FILTER (hits > 0) AS deferred_donors, CAST(sum(n) AS BIGINT) AS donations, CAST(sum(hits) AS BIGINT) AS deferred_donations,
round(100.0 * count(*) FILTER (hits > 0) / count(*), 6) AS donor_rate, round(100.0 * sum(hits) / sum(n), 6) AS donation_rate FROM d""")
def _(t):
    return describe.donor_max_deferral(t.joined()).withColumns({"donor_rate": r6("donor_rate"), "donation_rate": r6("donation_rate")})


def _counts(by):
    return f"""dd AS (SELECT {by}, donor, count(*) AS n, count(*) FILTER (Hb_deferral) AS hits, count(*) FILTER (Hb_deferral AND dateonly = last) AS lasts
  FROM (SELECT *, max(dateonly) OVER (PARTITION BY {by}, donor) AS last FROM base) GROUP BY {by}, donor),
sizes AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS donations, count(*) AS donors, CAST(sum(hits) AS BIGINT) AS deferrals, count(*) FILTER (hits > 0) AS deferred_donors, CAST(sum(lasts) AS BIGINT) AS deferred_last_donations FROM dd GROUP BY {by})"""


_AGED = f"""{JOINED}, base AS (SELECT *, CASE WHEN age >= 18 AND age < 25 THEN '[18,25)' WHEN age >= 25 AND age < 75 THEN '[' || CAST(age // 5 * 5 AS VARCHAR) || ',' || CAST(age // 5 * 5 + 5 AS VARCHAR) || ')' END AS age_class FROM joined)"""


@query("data_counts", f"WITH {JOINED}, base AS (SELECT * FROM joined), {_counts('label')} SELECT * FROM sizes")
def _(t):
    return describe.data_counts(t.joined(), ["label"])


@query("data_counts_by_age", f"WITH {_AGED}, {_counts('label, age_class')} SELECT * FROM sizes")
def _(t):
    return describe.data_counts_by_age(t.joined(), ["label"])


@query("deferral_rate_by_age", f"WITH {_AGED}, {_counts('label, age_class')} SELECT label, age_class, round(100.0 * deferred_last_donations / donors, 6) AS deferral_rate FROM sizes")
def _(t):
    return describe.deferral_rate_by_age(describe.data_counts_by_age(t.joined(), ["label"])).select("label", "age_class", r6("deferral_rate").alias("deferral_rate"))


@query("series_length_hist", f"""WITH {DONATIONS}, l AS (SELECT donor, count(*) AS n FROM donations GROUP BY donor)
SELECT CASE WHEN n <= 12 THEN CAST(n AS VARCHAR) ELSE 'Longer' END AS "Length", count(*) AS "Count" FROM l GROUP BY ALL""")
def _(t):
    return describe.series_length_hist(t.donations(), cap=12)


@query("suppressed_histogram", f"""WITH {JOINED}, c AS (SELECT Hb, CAST(age AS DOUBLE) AS age, CAST(nb_donat_progesa AS DOUBLE) AS nb FROM joined WHERE nb_donat_progesa IS NOT NULL),
l AS (SELECT 'Hb' AS name, Hb AS value FROM c UNION ALL SELECT 'age', age FROM c UNION ALL SELECT 'nb_donat_progesa', nb FROM c),
e AS (SELECT name, value, min(value) OVER (PARTITION BY name) AS lo, max(value) OVER (PARTITION BY name) AS hi FROM l),
b AS (SELECT name, CAST(least(greatest(ceil((value - lo) / ((hi - lo) / 30)), 1), 30) AS INTEGER) AS bin, lo, hi, count(*) AS n FROM e GROUP BY ALL)
SELECT name, bin, round(CASE WHEN bin = 1 THEN lo - (hi - lo) / 1000 ELSE lo + (bin - 1) * (hi - lo) / 30 END, 6) AS low, round(CASE WHEN bin = 30 THEN hi + (hi - lo) / 1000 ELSE lo + bin * (hi - lo) / 30 END, 6) AS high,
CASE WHEN n < 5 THEN 0 ELSE n END AS n FROM b""")
def _(t):
    h = describe.suppressed_histogram(t.joined(), ["Hb", "age", "nb_donat_progesa"])
    return h.select("name", "bin", r6("low").alias("low"), r6("high").alias("high"), "n")


@query("variable_summary", f"""WITH {JOINED}, l AS (SELECT 'Hb' AS name, Hb AS value FROM joined UNION ALL SELECT 'age', CAST(age AS DOUBLE) FROM joined UNION ALL SELECT 'nb_donat_progesa', CAST(nb_donat_progesa AS DOUBLE) FROM joined)
SELECT name, 'numeric' AS type, NULL AS value, NULL AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3,
  round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) FILTER (value IS NULL) AS nulls FROM l GROUP BY name
UNION ALL SELECT 'Hb_deferral', 'boolean', CAST(Hb_deferral AS VARCHAR), count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM joined GROUP BY Hb_deferral
UNION ALL SELECT 'sex', 'factor', sex, count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM joined GROUP BY sex""")
def _(t):
    v = describe.variable_summary(t.joined(), ["Hb", "age", "nb_donat_progesa"], ["Hb_deferral"], ["sex"])
    return v.select("name", "type", "value", "n", *[r6(c).alias(c) for c in ("mean", "sd", "median", "q1", "q3", "min", "max")], "nulls")


@query("sex_deferral_crosstab", f'WITH {JOINED} SELECT sex, count(*) FILTER (Hb_deferral) AS "true", count(*) FILTER (NOT Hb_deferral) AS "false" FROM joined GROUP BY sex')
def _(t):
    return describe.crosstab(t.joined(), "sex", "Hb_deferral", [True, False])


@query("deferral_by_career", f"""WITH {JOINED}, x AS (SELECT *, row_number() OVER (PARTITION BY donor ORDER BY date, don_id) + nb_donat_outside AS nb FROM joined)
SELECT sex, nb, count(*) FILTER (Hb_deferral) AS deferred, count(*) FILTER (NOT Hb_deferral) AS accepted, round(count(*) FILTER (Hb_deferral) / count(*), 6) AS rate FROM x GROUP BY sex, nb""")
def _(t):
    from donorflow.operators.series import running_index

    x = running_index(t.joined(), order=ORDER).withColumn("nb", F.col("i") + F.col("nb_donat_outside"))
    return describe.deferral_by_career(x, "sex", "nb").withColumn("rate", r6("rate"))


@query("career_stats", f"""WITH {JOINED} SELECT Hb_deferral, sex, count(*) AS n, max(volume_drawn) AS max, min(volume_drawn) AS min, round(avg(volume_drawn), 6) AS mean, round(median(volume_drawn), 6) AS median FROM joined GROUP BY Hb_deferral, sex""")
def _(t):
    return describe.career_stats(t.joined(), ["Hb_deferral", "sex"], "volume_drawn").withColumns({"mean": r6("mean"), "median": r6("median")})


@query("one_deferral", f"""WITH {JOINED} SELECT donor, segment, CAST(max(CAST(Hb_deferral AS INTEGER)) AS INTEGER) AS one_deferral, label FROM joined GROUP BY donor, segment, label""")
def _(t):
    return describe.one_deferral(t.joined().select("donor", "Hb_deferral", "label"), t.donors().select("donor", "segment"))


@query("label_balance", f"WITH {JOINED}, x AS (SELECT Hb_deferral FROM joined QUALIFY row_number() OVER (PARTITION BY donor ORDER BY date DESC, don_id DESC) = 1) SELECT Hb_deferral, count(*) AS n FROM x GROUP BY Hb_deferral")
def _(t):
    return describe.label_balance(t.joined(), order=ORDER)


@query("positives_report", f"WITH {JOINED} SELECT count(DISTINCT donor) AS donors FROM joined WHERE Hb_deferral")
def _(t):
    return describe.positives_report(t.joined())


@query("class_presence_check", f"WITH {JOINED} SELECT count(*) FILTER (Hb_deferral) AS deferred, count(*) FILTER (NOT Hb_deferral) AS accepted, TRUE AS ok FROM joined")
def _(t):
    return describe.class_presence_check(t.joined())


@query("constant_columns", f"WITH {DONATIONS} SELECT 'fixed' AS name FROM donations HAVING stddev_samp(Hb) > 0")
def _(t):
    return describe.constant_columns(t.donations().withColumn("fixed", F.lit(500)), ["fixed", "Hb", "volume_drawn"])


@query("cost_ratios", f"""WITH {JOINED}, x AS (SELECT *, row_number() OVER (PARTITION BY donor, donat_phleb = 'K' ORDER BY clock, don_id) AS nth FROM joined),
y AS (SELECT * FROM x WHERE dateonly BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'),
c AS (SELECT count(*) FILTER (donat_phleb = 'K') AS a, count(*) FILTER (donat_phleb = 'K' AND nth > 1) AS b, count(*) FILTER (donat_phleb = 'K' AND nth > 1 AND sex = 'male') AS bm, count(*) FILTER (donat_phleb = 'K' AND nth > 1 AND sex = 'female') AS bf,
  count(*) FILTER (donat_phleb = '*' AND Hb_deferral) AS l, count(*) FILTER (donat_phleb = '*' AND Hb_deferral AND sex = 'male') AS lm, count(*) FILTER (donat_phleb = '*' AND Hb_deferral AND sex = 'female') AS lf FROM y)
SELECT round(bm / b, 6) AS mr, round(bf / b, 6) AS fr, round(lm / l, 6) AS mdr, round(lf / l, 6) AS fdr, round(l / (l + a), 6) AS d FROM c""")
def _(t):
    c = describe.cost_ratios(t.joined(), "1997-01-01", "1999-12-31")
    return c.select(*[r6(n).alias(n) for n in c.columns])


@query("model_pair_totals", f"""WITH {JOINED}, x AS (SELECT segment AS data, label AS model, sex, CASE donat_phleb WHEN 'K' THEN 'a6' WHEN '*' THEN 'E6' ELSE 'q6' END AS variable, avg(Hb) AS value FROM joined GROUP BY ALL)
SELECT data, model, round(sum(value) FILTER (variable = 'a6') - 1, 6) AS a6, round(sum(value) FILTER (variable = 'E6'), 6) AS E6, round(sum(value) FILTER (variable = 'q6'), 6) AS q6 FROM x GROUP BY data, model""")
def _(t):
    from donorflow.functions.expr import recode

    j = t.joined().withColumn("variable", recode("donat_phleb", {"K": "a6", "*": "E6"}, "q6"))
    long = j.groupBy(F.col("segment").alias("data"), F.col("label").alias("model"), "sex", "variable").agg(F.avg("Hb").alias("value"))
    return describe.model_pair_totals(long).select("data", "model", *[r6(c).alias(c) for c in ("a6", "E6", "q6")])


@query("r_squared", f"WITH {SCORES} SELECT round(pow(corr(original_value, predicted_value), 2), 6) AS r2 FROM scores")
def _(t):
    return describe.r_squared(t.scores(), "original_value", "predicted_value").select(r6("r2").alias("r2"))
