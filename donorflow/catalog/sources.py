"""Scans, checks and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorflow.catalog.bindings import DONATIONS, DONORS, FEATURES, JOINED, Tables, query, r6
from donorflow.operators import describe, models, series
from donorflow.plans.features import Settings, whole_series_features
from donorflow.session import workspace
from donorflow.sources import checks, delimited


def text_of(frame, names, header, folder):
    """Write the columns as pipe-delimited lines and return the folder."""
    frame.select(*names).write.mode("overwrite").csv(folder, sep="|", header=header)
    return folder


def positional_donations(t: Tables):
    raw = t.raw_donations()
    have = set(raw.columns)
    return raw.select(*[F.col(c) if c in have else F.lit("x").alias(c) for c in delimited.POSITIONAL_DONATIONS])


def positional_donors(t: Tables):
    raw = t.raw_donors().withColumn("KEY_DONOR_SEX", F.when(F.col("KEY_DONOR_SEX") == "M", "Man").when(F.col("KEY_DONOR") % 10 == 0, "?").otherwise("Woman"))
    have = set(raw.columns)
    return raw.select(*[F.col(c) if c in have else F.lit("7").alias(c) for c in delimited.POSITIONAL_DONORS])


@query("scan_donations_positional", f"""WITH {DONATIONS}
SELECT CAST(donor AS VARCHAR) AS donor, strftime(date, '%Y%m%d') AS day, status, donat_phleb, CAST(volume_drawn AS DOUBLE) AS volume, round(Hb, 6) AS hb FROM donations""")
def _(t):
    folder = text_of(positional_donations(t), delimited.POSITIONAL_DONATIONS, False, workspace(t.spark, "scan"))
    s = delimited.scan_donations_positional(t.spark, folder)
    return s.select(F.col("KEY_DONOR").alias("donor"), F.col("KEY_DONAT_INDEX_DATE").alias("day"), F.col("DONAT_STATUS").alias("status"),
                    F.col("KEY_DONAT_PHLEB").alias("donat_phleb"), F.col("DONAT_VOL_DRAWN").alias("volume"), r6("DONAT_RESULT_CODE").alias("hb"))


@query("scan_donors_positional", f"""WITH {DONORS}
SELECT CAST(donor AS VARCHAR) AS donor, CASE WHEN sex = 'M' THEN 'M' WHEN donor % 10 = 0 THEN NULL ELSE 'F' END AS sex, strftime(dob, '%Y%m%d') AS dob, 7 AS n FROM donors""")
def _(t):
    folder = text_of(positional_donors(t), delimited.POSITIONAL_DONORS, False, workspace(t.spark, "scan"))
    s = delimited.scan_donors_positional(t.spark, folder)
    return s.select(F.col("KEY_DONOR").alias("donor"), F.col("KEY_DONOR_SEX").alias("sex"), F.col("KEY_DONOR_DOB").alias("dob"), F.col("DONOR_NB_DONATIONS").alias("n"))


@query("scan_donations_named", f"""WITH {DONATIONS}
SELECT CAST(donor AS VARCHAR) AS donor, strftime(date, '%Y%m%d') AS day, strftime(date, '%H%M') AS start, status, donat_phleb, volume_drawn AS volume, round(Hb, 6) AS hb FROM donations""")
def _(t):
    folder = text_of(t.raw_donations(), list(delimited.NAMED_DONATIONS), True, workspace(t.spark, "scan"))
    s = delimited.scan_donations_named(t.spark, folder)
    return s.select(F.col("KEY_DONOR").alias("donor"), F.col("KEY_DONAT_INDEX_DATE").alias("day"), F.col("DONAT_PHLEB_START").alias("start"), F.col("DONAT_STATUS").alias("status"),
                    F.col("KEY_DONAT_PHLEB").alias("donat_phleb"), F.col("DONAT_VOL_DRAWN").alias("volume"), r6("DONAT_RESULT_CODE").alias("hb"))


@query("scan_donors_named", f"""WITH {DONORS}
SELECT CAST(donor AS VARCHAR) AS donor, sex, strftime(dob, '%Y%m%d') AS dob, strftime(date_first_donation, '%Y%m%d') AS first, round(FERRITIN_FIRST, 6) AS ferritin FROM donors""")
def _(t):
    d = t.donors().select(
        F.col("donor").alias("KEY_DONOR"), F.col("sex").alias("KEY_DONOR_SEX"), F.date_format("dob", "yyyyMMdd").alias("KEY_DONOR_DOB"),
        F.date_format("date_first_donation", "yyyyMMdd").alias("DONOR_DATE_FIRST_DONATION"), "FERRITIN_FIRST")
    s = delimited.scan_donors_named(t.spark, text_of(d, d.columns, True, workspace(t.spark, "scan")))
    return s.select(F.col("KEY_DONOR").alias("donor"), F.col("KEY_DONOR_SEX").alias("sex"), F.col("KEY_DONOR_DOB").alias("dob"),
                    F.col("DONOR_DATE_FIRST_DONATION").alias("first"), r6("FERRITIN_FIRST").alias("ferritin"))


@query("unit_sanity", f"WITH {DONATIONS} SELECT round(avg(Hb), 6) AS mean, avg(Hb) > 100 AND avg(Hb) < 200 AS sane FROM donations")
def _(t):
    return checks.unit_sanity(t.donations(), "gperl").withColumn("mean", r6("mean"))


@query("na_contract", f"""WITH {DONORS}
SELECT name, nulls, nulls = 0 AS ok FROM (
  SELECT 'donor' AS name, count(*) FILTER (donor IS NULL) AS nulls FROM donors UNION ALL SELECT 'dob', count(*) FILTER (dob IS NULL) FROM donors
  UNION ALL SELECT 'sex', count(*) FILTER (sex IS NULL) FROM donors UNION ALL SELECT 'nb_donat_progesa', count(*) FILTER (nb_donat_progesa IS NULL) FROM donors)""")
def _(t):
    return checks.na_contract(t.donors().select("donor", "dob", "sex", "nb_donat_progesa", "FERRITIN_FIRST"), ["FERRITIN_FIRST"])


@query("na_counts", f"""WITH {DONORS}
SELECT 'FERRITIN_FIRST' AS name, count(*) FILTER (FERRITIN_FIRST IS NULL) AS nulls FROM donors UNION ALL
SELECT 'FERRITIN_LAST', count(*) FILTER (FERRITIN_LAST IS NULL) FROM donors UNION ALL
SELECT 'nb_donat_progesa', count(*) FILTER (nb_donat_progesa IS NULL) FROM donors""")
def _(t):
    return checks.na_counts(t.donors(), ["FERRITIN_FIRST", "FERRITIN_LAST", "nb_donat_progesa"])


@query("column_summary", f"""WITH {DONATIONS}
SELECT name, count(value) AS n, count(*) FILTER (value IS NULL) AS nulls, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(max(value), 6) AS max,
  round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3
FROM (SELECT 'Hb' AS name, Hb AS value FROM donations UNION ALL SELECT 'volume_drawn', CAST(volume_drawn AS DOUBLE) FROM donations) GROUP BY name""")
def _(t):
    s = checks.column_summary(t.donations(), ["Hb", "volume_drawn"])
    return s.select("name", "n", "nulls", *[r6(c).alias(c) for c in ("min", "mean", "max", "q1", "median", "q3")])


@query("write_delimited", f"WITH {DONORS} SELECT CAST(donor AS VARCHAR) AS donor, sex, CAST(dob AS VARCHAR) AS dob, label FROM donors")
def _(t):
    folder = workspace(t.spark, "out")
    delimited.write_delimited(t.donors().select("donor", "sex", "dob", "label"), folder)
    return t.spark.read.csv(folder, sep="|", header=True)


@query("save_preprocessed", f"WITH {FEATURES} SELECT don_id, sex, age, recent_donations FROM features WHERE sex = 'male'")
def _(t):
    folder = workspace(t.spark, "features")
    delimited.save_preprocessed(whole_series_features(t.raw_donations(), t.raw_donors(), Settings(), check=False), folder)
    return delimited.load_preprocessed(t.spark, folder, "male").select("don_id", "sex", "age", "recent_donations")


@query("result_sink", f"""WITH {JOINED},
dd AS (SELECT sex, label, donor, count(*) AS n, count(*) FILTER (Hb_deferral) AS hits FROM joined GROUP BY sex, label, donor),
x AS (SELECT sex, label, sum(n) AS donations, count(*) AS donors, sum(hits) AS deferrals FROM dd GROUP BY sex, label)
SELECT 'bl-' || sex AS Id, label, CAST(donations AS BIGINT) AS donations, donors, CAST(deferrals AS BIGINT) AS deferrals FROM x""")
def _(t):
    rows = t.joined()
    sizes = {f"bl-{s}": describe.data_counts(rows.filter(F.col("sex") == s), ["label"]) for s in ("male", "female")}
    path = delimited.result_sink({"sizes": sizes}, workspace(t.spark, "results"))["sizes"]
    back = t.spark.read.csv(path, header=True)
    return back.select("Id", "label", *[F.col(c).cast("long").alias(c) for c in ("donations", "donors", "deferrals")])


@query("append_prefitted")
def _(t):
    features = ["previous_Hb", "age"]
    rows = series.hb_lags(t.joined(), order=("clock", "don_id"), n=1)
    folder, stored = workspace(t.spark, "models"), {}
    for sex in ("male", "female"):
        model = models.decision_tree(rows.filter(F.col("sex") == sex), features, maxDepth=3)
        stored[("dt", sex)] = models.save_model(model, folder, "dt", sex)
    scored = models.append_prefitted(rows, stored, [("dt", "male"), ("dt", "female")], features)
    return scored.select("Id", "don_id", r6("score").alias("score"))
