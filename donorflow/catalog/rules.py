"""Exclusion rules and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorflow.catalog.bindings import ATTEMPTS, CHAIN, DONATIONS, JOINED, query
from donorflow.operators import rules, series
from donorflow.plans.features import REASONS, Settings, audit

# tables after each rule; rules 7, 8 and 12 are off or drop nothing here
_AFTER = {1: "s1", 2: "s2", 3: "s3", 4: "s4", 5: "s5", 6: "s6", 7: "s6", 8: "s6", 9: "s9", 10: "s10", 11: "s11", 12: "s11"}


def _audit_sql():
    parts, before = [], "joined"
    for step, reason in REASONS:
        after = _AFTER[step]
        parts.append(
            f"SELECT {step} AS step, '{reason}' AS reason, (SELECT count(*) FROM {before}) AS rows_before, (SELECT count(*) FROM {before}) - (SELECT count(*) FROM {after}) AS rows_dropped, "
            f"(SELECT count(DISTINCT donor) FROM {before}) AS donors_before, (SELECT count(DISTINCT donor) FROM {before}) - (SELECT count(DISTINCT donor) FROM {after}) AS donors_dropped"
        )
        before = after
    return f"WITH {CHAIN} " + " UNION ALL ".join(parts)


@query("exclusion_audit", _audit_sql())
def _(t):
    return audit(t.raw_donations(), t.raw_donors(), Settings(), check=False)


@query("drop_birth_equals_event", f"""WITH {JOINED}, x AS (SELECT don_id, dateonly, CASE WHEN don_id % 19 = 0 THEN dateonly ELSE dob END AS dob FROM joined)
SELECT don_id FROM x WHERE dateonly IS DISTINCT FROM dob""")
def _(t):
    x = t.joined().withColumn("dob", F.when(F.col("don_id") % 19 == 0, F.col("dateonly")).otherwise(F.col("dob")))
    return rules.drop_birth_equals_event(x).select("don_id")


@query("drop_null_dates", f"WITH {JOINED} SELECT don_id FROM joined WHERE don_id % 19 <> 0")
def _(t):
    x = t.joined().withColumn("dob", F.when(F.col("don_id") % 19 != 0, F.col("dob")))
    return rules.drop_null_dates(x).select("don_id")


@query("drop_sentinel_date", f"WITH {DONATIONS} SELECT don_id FROM donations WHERE dateonly <> DATE '1997-05-28'")
def _(t):
    return rules.drop_sentinel_date(t.donations(), sentinel="1997-05-28").select("don_id")


@query("drop_minors", f"WITH {JOINED} SELECT don_id, age FROM joined WHERE age >= 18")
def _(t):
    return rules.drop_minors(t.joined()).select("don_id", "age")


@query("drop_null_hb", f"WITH {DONATIONS} SELECT don_id FROM donations WHERE volume_drawn >= 60")
def _(t):
    return rules.drop_null_hb(t.donations().withColumn("Hb", F.when(F.col("volume_drawn") >= 60, F.col("Hb")))).select("don_id")


@query("last_try_of_day", f"""WITH {ATTEMPTS} SELECT don_id, count(*) OVER (PARTITION BY donor, dateonly) AS tries FROM attempts QUALIFY date = max(date) OVER (PARTITION BY donor, dateonly)""")
def _(t):
    return rules.last_try_of_day(t.attempts()).select("don_id", F.col("triesOnTheDay").alias("tries"))


@query("restrict_time_window", f"""WITH {DONATIONS} SELECT don_id FROM donations WHERE epoch(dateonly) >= (SELECT epoch(max(dateonly)) FROM donations) - 5 * 31557600""")
def _(t):
    return rules.restrict_time_window(t.donations()).select("don_id")


@query("active_last_year", f"""WITH {DONATIONS} SELECT don_id FROM donations QUALIFY bool_or(epoch(dateonly) >= (SELECT epoch(max(dateonly)) FROM donations) - 31557600) OVER (PARTITION BY donor)""")
def _(t):
    return rules.active_last_year(t.donations()).select("don_id")


@query("first_event_flag", f"WITH {DONATIONS} SELECT don_id, dateonly = min(dateonly) OVER (PARTITION BY donor) AS first_event FROM donations")
def _(t):
    return rules.first_event_flag(t.donations()).select("don_id", "first_event")


_FIRST = f"""WITH {DONATIONS}, x AS (SELECT *, dateonly = min(dateonly) OVER (PARTITION BY donor) AS first_event, CASE WHEN volume_drawn >= 150 THEN Hb END AS hb2 FROM donations)"""


@query("drop_first_hb_null", f"{_FIRST} SELECT don_id FROM x QUALIFY NOT bool_or(first_event AND hb2 IS NULL) OVER (PARTITION BY donor)")
def _(t):
    x = rules.first_event_flag(t.donations()).withColumn("Hb", F.when(F.col("volume_drawn") >= 150, F.col("Hb")))
    return rules.drop_first_hb_null(x).select("don_id")


@query("first_within_tolerance", f"""WITH {JOINED} SELECT don_id FROM joined QUALIFY min(dateonly) OVER (PARTITION BY donor) - min(date_first_donation) OVER (PARTITION BY donor) BETWEEN 0 AND 400""")
def _(t):
    return rules.first_within_tolerance(t.joined(), max_diff=400).select("don_id")


@query("keep_whole_blood_or_deferral", f"WITH {DONATIONS} SELECT don_id FROM donations WHERE donat_phleb IN ('K', '*')")
def _(t):
    return rules.keep_whole_blood_or_deferral(t.donations()).select("don_id")


@query("drop_lost_first_event", f"{_FIRST} SELECT don_id FROM x WHERE donat_phleb IN ('K', '*') QUALIFY bool_or(first_event) OVER (PARTITION BY donor)")
def _(t):
    return rules.drop_lost_first_event(rules.keep_whole_blood_or_deferral(rules.first_event_flag(t.donations()))).select("don_id")


@query("drop_unknown_interval", f"WITH {CHAIN} SELECT don_id FROM s8 WHERE first_event OR (days_to_previous_fb IS NOT NULL AND Hb IS NOT NULL)")
def _(t):
    x = rules.last_try_of_day(rules.drop_minors(t.joined()))
    x = series.days_to_previous_fb(rules.first_event_flag(x), order=("clock", "don_id"))
    return rules.drop_unknown_interval(x).select("don_id")


@query("min_history", f"""WITH {DONATIONS}, x AS (SELECT don_id, count(*) OVER (PARTITION BY donor) AS n FROM donations)
SELECT 'least' AS kind, don_id FROM x WHERE n >= 7 UNION ALL SELECT 'most', don_id FROM x WHERE n <= 5 UNION ALL SELECT 'exact', don_id FROM x WHERE n = 10""")
def _(t):
    d = t.donations()
    parts = [rules.min_history(d, h, exactly=e).select(F.lit(k).alias("kind"), "don_id") for k, h, e in (("least", 7, False), ("most", -5, False), ("exact", 10, True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("drop_single_event_donors", f"WITH {DONATIONS} SELECT don_id FROM donations QUALIFY count(*) OVER (PARTITION BY donor) > 1")
def _(t):
    return rules.drop_single_event_donors(t.donations()).select("don_id")


@query("last_event_per_donor", f"WITH {DONATIONS} SELECT don_id, donor FROM donations QUALIFY rank() OVER (PARTITION BY donor ORDER BY dateonly DESC) = 1")
def _(t):
    return rules.last_event_per_donor(t.donations()).select("don_id", "donor")


@query("drop_zero_count", f"WITH {JOINED} SELECT don_id FROM joined WHERE coalesce(nb_donat_progesa, 0) + coalesce(nb_donat_outside, 0) <> 0")
def _(t):
    return rules.drop_zero_count(t.joined(), ["nb_donat_progesa", "nb_donat_outside"]).select("don_id")


@query("drop_too_soon", f"""WITH {CHAIN} SELECT don_id FROM s8 WHERE NOT (days_to_previous_fb < 62 AND sex = 'male') AND NOT (days_to_previous_fb < 92 AND sex = 'female')""")
def _(t):
    x = rules.last_try_of_day(rules.drop_minors(t.joined()))
    return rules.drop_too_soon(series.days_to_previous_fb(x, order=("clock", "don_id"))).select("don_id")


@query("drop_suspicious_last", f"""WITH {JOINED}, x AS (SELECT don_id, lag(Hb_deferral AND volume_drawn > 100) OVER w AS odd, lead(don_id) OVER w AS nxt FROM joined WINDOW w AS (PARTITION BY donor ORDER BY clock, don_id))
SELECT don_id FROM x WHERE NOT (nxt IS NULL AND coalesce(odd, FALSE))""")
def _(t):
    return rules.drop_suspicious_last(t.joined(), ["clock", "don_id"]).select("don_id")


@query("bad_id_filter", "SELECT o_orderkey FROM orders WHERE regexp_matches('Y' || lpad(CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN 13 ELSE 14 END, '0') || 'A', '^Y[0-9]{14}.$')")
def _(t):
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lpad(key, 13, "0")).otherwise(F.lpad(key, 14, "0"))
    rows = t.table("orders").withColumn("ident", F.concat(F.lit("Y"), text, F.lit("A")))
    return rules.bad_id_filter(rows, "ident").select("o_orderkey")


@query("generic_filter", f"""WITH {JOINED} SELECT don_id FROM joined WHERE sex = 'female' AND donat_phleb = 'K' AND Hb > 120 AND Hb < 160 AND age > 20 AND age < 40""")
def _(t):
    return rules.generic_filter(t.joined(), {"sex": "female", "donat_phleb": "K"}, {"Hb": (120, 160), "age": (20, 40)}).select("don_id")
