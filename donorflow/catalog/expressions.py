"""Column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorflow.catalog.bindings import ATTEMPTS, DONATIONS, DONORS, JOINED, SCORES, query, r6
from donorflow.functions import expr
from donorflow.functions.metadata import DONATION_VARIABLES
from donorflow.operators import describe


@query("rename_map", f"WITH {DONATIONS} SELECT donor AS subject, don_id AS event, donat_phleb FROM donations")
def _(t):
    return expr.rename_map(t.donations().select("donor", "don_id", "donat_phleb"), {"donor": "subject", "don_id": "event", "absent": "x"})


@query("convert_hb_unit", f"""WITH {DONATIONS} SELECT don_id, round(Hb / 10, 6) AS dl, round(Hb * 0.01551 * 4, 6) AS mmol, round(Hb / (0.01551 * 4), 6) AS back FROM donations""")
def _(t):
    return t.donations().select(
        "don_id", r6(expr.convert_hb_unit("Hb", "gperl", "gperdl")).alias("dl"), r6(expr.convert_hb_unit("Hb", "gperl", "mmolperl")).alias("mmol"),
        r6(expr.convert_hb_unit("Hb", "mmolperl", "gperl")).alias("back"))


@query("to_mmol", f"WITH {DONATIONS} SELECT don_id, round(Hb * 0.06204, 6) AS mmol FROM donations")
def _(t):
    return t.donations().select("don_id", r6(expr.to_mmol("Hb")).alias("mmol"))


@query("parse_event_ts", f"""WITH {DONATIONS},
raw AS (SELECT don_id, CASE WHEN don_id % 17 = 0 THEN '2015-13-99' ELSE strftime(date, '%Y%m%d') END AS d,
  CASE WHEN don_id % 5 = 0 THEN NULL ELSE CAST((don_id % 24) * 100 + don_id % 60 AS VARCHAR) END AS h, dateonly FROM donations)
SELECT don_id, CASE WHEN don_id % 17 <> 0 THEN CAST(epoch(dateonly + to_hours(CASE WHEN h IS NULL THEN 0 ELSE don_id % 24 END) + to_minutes(CASE WHEN h IS NULL THEN 0 ELSE don_id % 60 END)) AS BIGINT) END AS at FROM raw""")
def _(t):
    raw = t.donations().select(
        "don_id", F.when(F.col("don_id") % 17 == 0, "2015-13-99").otherwise(F.date_format("date", "yyyyMMdd")).alias("d"),
        F.when(F.col("don_id") % 5 != 0, (F.col("don_id") % 24 * 100 + F.col("don_id") % 60).cast("string")).alias("h"))
    return raw.select("don_id", F.unix_timestamp(expr.parse_event_ts("d", "h")).alias("at"))


@query("parse_dob", f"WITH {DONORS} SELECT donor, CASE WHEN donor % 9 <> 0 THEN dob END AS dob FROM donors")
def _(t):
    text = F.when(F.col("donor") % 9 == 0, "19xx0101").otherwise(F.date_format("dob", "yyyyMMdd"))
    return t.donors().select("donor", expr.parse_day(text).alias("dob"))


@query("age_at_event", f"WITH {JOINED} SELECT don_id, age FROM joined")
def _(t):
    return t.joined().select("don_id", expr.age_at_event("dob", "date").alias("age"))


@query("date_parts", f"""WITH {ATTEMPTS} SELECT don_id, year(date)::INTEGER AS year, month(date)::INTEGER AS month, day(date)::INTEGER AS day, hour(date)::INTEGER AS hour,
  ((dayofyear(date) - 1) // 7 + 1)::INTEGER AS week FROM attempts""")
def _(t):
    return t.attempts().select("don_id", *[c.alias(n.lower()) for n, c in expr.date_parts("date").items()])


@query("hour_numeric", f"WITH {ATTEMPTS} SELECT don_id, round(hour(date) + minute(date) / 60.0, 6) AS hour FROM attempts")
def _(t):
    return t.attempts().select("don_id", r6(expr.hour_numeric("date")).alias("hour"))


@query("impute_midnight_hour", f"""WITH {ATTEMPTS}, h AS (SELECT don_id, CASE WHEN hour(date) = 0 THEN 0 ELSE hour(date) + minute(date) / 60.0 END AS hour FROM attempts)
SELECT don_id, round(CASE WHEN hour = 0 THEN (SELECT avg(hour) FROM h WHERE hour <> 0) ELSE hour END, 6) AS hour FROM h""")
def _(t):
    rows = t.attempts().select("don_id", F.when(F.hour("date") == 0, 0.0).otherwise(expr.hour_numeric("date")).alias("hour"))
    mean = rows.filter("hour <> 0").agg(F.avg("hour").alias("m")).scalar()
    return rows.select("don_id", r6(F.when(F.col("hour") == 0, mean).otherwise(F.col("hour"))).alias("hour"))


@query("warm_season", f"""WITH {DONATIONS} SELECT don_id, CASE WHEN month(date) BETWEEN 4 AND 9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS north,
  CASE WHEN month(date) BETWEEN 4 AND 9 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS south FROM donations""")
def _(t):
    return t.donations().select("don_id", expr.warm_season(F.month("date")).alias("north"), expr.warm_season(F.month("date"), True).alias("south"))


@query("hb_deferral", f"WITH {JOINED} SELECT don_id, Hb_deferral FROM joined")
def _(t):
    return t.joined().select("don_id", expr.hb_deferral("Hb", "sex", 135, 125).alias("Hb_deferral"))


@query("recode_levels", f"WITH {DONORS} SELECT donor, CASE sex WHEN 'F' THEN 'female' ELSE 'male' END AS sex FROM donors")
def _(t):
    return t.donors().select("donor", expr.recode("sex", {"F": "female", "M": "male"}).alias("sex"))


@query("label_deferral", f"WITH {JOINED} SELECT don_id, CASE WHEN Hb_deferral THEN 'Deferred' ELSE 'Accepted' END AS label FROM joined")
def _(t):
    return t.joined().select("don_id", expr.label_deferral("Hb_deferral").alias("label"))


@query("bool_to_int", f"WITH {JOINED} SELECT don_id, CAST(Hb_deferral AS INTEGER) AS Hb_deferral FROM joined")
def _(t):
    return expr.bool_to_int(t.joined().select("don_id", "Hb_deferral"))


ANSWERS = {
    "physical_condition": ["very_bad", "rather_bad", "satisfactory", "rather_good", "good", "excellent", "other"],
    "meat_amount": ["never", "less_than_once_weekly", "1.3_week", "4.6_week", "daily", "several_daily", "other"],
    "sleep_quality": ["never", "rarely", "mostly", "always_or_almost", "other", "never", "rarely"],
}


@query("ordinal_encode", f"""WITH {DONORS} SELECT donor, CASE WHEN donor % 7 < 6 THEN donor % 7 END AS physical_condition, CASE WHEN donor % 7 < 6 THEN donor % 7 END AS meat_amount,
  CASE donor % 7 WHEN 4 THEN NULL WHEN 5 THEN 0 WHEN 6 THEN 1 ELSE donor % 7 END AS sleep_quality, CASE WHEN donor % 2 = 0 THEN 0::BIGINT ELSE 1::BIGINT END AS smoking_status,
  CASE WHEN donor % 3 = 0 THEN 0 ELSE donor % 40 END AS iron_supplement FROM donors""")
def _(t):
    key = F.col("donor")
    cols = [F.get(F.array(*[F.lit(a) for a in names]), (key % 7).cast("int")).alias(n) for n, names in ANSWERS.items()]
    rows = t.donors().select("donor", *cols, F.when(key % 2 == 0, "no").otherwise("daily").alias("smoking_status"),
                             (key % 3 != 0).alias("iron_supp"), (key % 40).alias("iron_comp_c"))
    out = expr.ordinal_encode(rows)
    return out.select("donor", *[F.col(c).cast("long").alias(c) for c in out.columns if c != "donor"])


@query("log_interval", f"WITH {DONATIONS} SELECT don_id, round(ln(volume_drawn + 1), 6) AS x FROM donations")
def _(t):
    return t.donations().select("don_id", r6(expr.log_interval(F.col("volume_drawn") + 1)).alias("x"))


@query("pretty_names", f"""WITH {JOINED} SELECT donor AS "Donor ID", age AS "Age", sex AS "Sex", don_id FROM joined""")
def _(t):
    return expr.pretty_names(t.joined().select("donor", "age", "sex", "don_id"), DONATION_VARIABLES)


@query("prettify_variables", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Previous donation deferred' WHEN 1 THEN 'Warm season' WHEN 2 THEN 'Smoking' WHEN 3 THEN 'RNF43 minor allele'
  WHEN 4 THEN 'Sex' WHEN 5 THEN 'Number of donations' ELSE p_name END AS pretty FROM part""")
def _(t):
    names = ["previous_Hb_defTRUE", "warm_seasonTRUE", "smokingTRUE", "RNF43_mutantTRUE", "sexfemale", "nb_donat", "age"]
    rows = t.table("part").withColumn("Variable", F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 7).cast("int")))
    return rows.select("p_partkey", expr.prettify_variables("Variable", "p_name", True).alias("pretty"))


@query("split_id", f"WITH {SCORES} SELECT id, 'data' AS data, CASE WHEN grp = 'F' THEN 'female' ELSE 'male' END AS sex, 'rf' AS model FROM scores")
def _(t):
    return t.scores().select("id", *[c.alias(n) for n, c in expr.split_id("run").items()])


@query("extract_name_month", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'E' END AS name, CASE WHEN c_custkey % 3 = 1 THEN 6 WHEN c_custkey % 3 = 2 THEN 12 END AS month FROM customer")
def _(t):
    key = F.col("c_custkey")
    rows = t.table("customer").withColumn("v", F.when(key % 3 == 1, "E6").when(key % 3 == 2, "E12").otherwise("none"))
    return rows.select("c_custkey", *[c.alias(n) for n, c in expr.extract_name_month("v").items()])


def _text(value):
    """SQL that shows a double the way Spark does for the numbers at hand."""
    return f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({value} AS VARCHAR) END"


@query("mean_sd_text", f"""WITH {DONATIONS}, x AS (SELECT 'Hb' AS name, round(avg(Hb), 2) AS m, round(stddev_samp(Hb), 2) AS s FROM donations
  UNION ALL SELECT 'volume_drawn', round(avg(volume_drawn), 2), round(stddev_samp(volume_drawn), 2) FROM donations)
SELECT name, {_text('m')} || ' (' || {_text('s')} || ')' AS text FROM x""")
def _(t):
    return describe.mean_sd_text(t.donations(), ["Hb", "volume_drawn"])


@query("med_iq_text", f"""WITH {DONATIONS}, x AS (SELECT 'volume_drawn' AS name, quantile_cont(CAST(volume_drawn AS DOUBLE), 0.5) AS m, quantile_cont(CAST(volume_drawn AS DOUBLE), 0.25) AS lo, quantile_cont(CAST(volume_drawn AS DOUBLE), 0.75) AS hi FROM donations
  UNION ALL SELECT 'clock', quantile_cont(CAST(clock // 86400 AS DOUBLE), 0.5), quantile_cont(CAST(clock // 86400 AS DOUBLE), 0.25), quantile_cont(CAST(clock // 86400 AS DOUBLE), 0.75) FROM donations)
SELECT name, {_text('m')} || ' (' || {_text('lo')} || ', ' || {_text('hi')} || ')' AS text FROM x""")
def _(t):
    rows = t.donations().select("volume_drawn", F.floor(F.col("clock") / 86400).alias("clock"))
    return describe.med_iq_text(rows, ["volume_drawn", "clock"])


@query("confusion_class", f"""WITH {SCORES} SELECT id, CASE WHEN label = 1 AND predicted = 1 THEN 'True positive' WHEN label = 1 THEN 'False negative' WHEN predicted = 1 THEN 'False positive' ELSE 'True negative' END AS class FROM scores""")
def _(t):
    return t.scores().select("id", expr.confusion_class("label", "predicted").alias("class"))
