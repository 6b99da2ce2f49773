"""Time-series features and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorflow.catalog.bindings import ATTEMPTS, DONATIONS, FEATURES, JOINED, SCORES, query, r6
from donorflow.operators import ordering, series
from donorflow.plans.features import FEATURE_COLUMNS, Settings, whole_series_features

ORDER = ("clock", "don_id")
W = "OVER (PARTITION BY donor ORDER BY date, don_id)"
_ROUND = {"Hb", "Hb_first", "hour", "previous_Hb", "previous_Hb2", "previous_Hb3", "previous_Hb4", "previous_Hb5"}


@query("whole_series_features", f"WITH {FEATURES} SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUND else c for c in FEATURE_COLUMNS) + ", label FROM features")
def _(t):
    f = whole_series_features(t.raw_donations(), t.raw_donors(), Settings(), check=False)
    return f.select(*[r6(c).alias(c) if c in _ROUND else F.col(c) for c in FEATURE_COLUMNS], "label")


@query("event_sequence_id", f"WITH {DONATIONS} SELECT don_id, row_number() OVER (ORDER BY date, don_id) AS seq FROM donations")
def _(t):
    return series.event_sequence_id(t.donations().select("date", "don_id")).select("don_id", "seq")


@query("days_to_previous_fb", f"""WITH {DONATIONS}, x AS (SELECT *, CASE WHEN (donat_phleb = 'K' AND status = '-') OR (donat_phleb = 'K' AND status <> '-' AND volume_drawn > 100) OR (donat_phleb = 'H' AND volume_drawn > 100) THEN dateonly END AS fb FROM donations)
SELECT don_id, CAST(dateonly - last_value(fb IGNORE NULLS) OVER (PARTITION BY donor ORDER BY date, don_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS days_to_previous_fb FROM x""")
def _(t):
    return series.days_to_previous_fb(t.donations(), order=ORDER).select("don_id", "days_to_previous_fb")


@query("previous_deferral", f"WITH {JOINED} SELECT don_id, lag(Hb_deferral) {W} AS previous_Hb_def FROM joined")
def _(t):
    return series.previous_deferral(t.joined(), order=ORDER).select("don_id", "previous_Hb_def")


@query("first_hb", f"WITH {DONATIONS} SELECT don_id, first_value(Hb) {W} AS Hb_first FROM donations")
def _(t):
    return series.first_hb(t.donations(), order=ORDER).select("don_id", "Hb_first")


@query("hb_lags", f"WITH {DONATIONS} SELECT don_id, lag(Hb, 1, 0.0) {W} AS previous_Hb, " + ", ".join(f"lag(Hb, {i}) {W} AS previous_Hb{i}" for i in range(2, 6)) + " FROM donations")
def _(t):
    return series.hb_lags(t.donations(), order=ORDER).select("don_id", "previous_Hb", *[f"previous_Hb{i}" for i in range(2, 6)])


@query("day_gaps", f"WITH {DONATIONS} SELECT don_id, " + ", ".join(f"CAST(dateonly - lag(dateonly, {i}) {W} AS INTEGER) AS gap{i}" for i in range(1, 6)) + " FROM donations")
def _(t):
    g = series.day_gaps(t.donations(), order=ORDER)
    return g.select("don_id", *[F.col(f"days_to_previous_Hb{'' if i == 1 else i}").alias(f"gap{i}") for i in range(1, 6)])


@query("fill_forward", f"""WITH {DONATIONS}, x AS (SELECT *, CASE WHEN volume_drawn > 300 THEN Hb END AS v FROM donations)
SELECT don_id, last_value(v IGNORE NULLS) OVER (PARTITION BY donor ORDER BY date, don_id ROWS UNBOUNDED PRECEDING) AS v FROM x""")
def _(t):
    x = t.donations().withColumn("v", F.when(F.col("volume_drawn") > 300, F.col("Hb")))
    return series.fill_forward(x, "v", order=ORDER).select("don_id", "v")


@query("consecutive_deferrals", f"""WITH {JOINED}, x AS (SELECT *, sum(CAST(Hb_deferral AS INTEGER)) OVER (PARTITION BY donor ORDER BY date, don_id ROWS UNBOUNDED PRECEDING) AS c FROM joined),
y AS (SELECT *, last_value(CASE WHEN NOT Hb_deferral THEN c END IGNORE NULLS) OVER (PARTITION BY donor ORDER BY date, don_id ROWS UNBOUNDED PRECEDING) AS c0 FROM x)
SELECT don_id, CAST(lag(c - coalesce(c0, 0), 1, 0) {W} AS INTEGER) AS consecutive_deferrals FROM y""")
def _(t):
    return series.consecutive_deferrals(t.joined(), order=ORDER).select("don_id", "consecutive_deferrals")


@query("recent_donations", f"""WITH {DONATIONS} SELECT don_id, CAST(sum(CASE WHEN donat_phleb = 'K' THEN 1 ELSE 0 END) OVER (PARTITION BY donor ORDER BY clock RANGE BETWEEN 157788000 PRECEDING AND CURRENT ROW) - CASE WHEN donat_phleb = 'K' THEN 1 ELSE 0 END AS INTEGER) AS recent_donations FROM donations""")
def _(t):
    return series.recent_donations(t.donations()).select("don_id", "recent_donations")


@query("recent_deferrals", f"""WITH {JOINED} SELECT don_id, CAST(sum(CAST(Hb_deferral AS INTEGER)) OVER (PARTITION BY donor ORDER BY clock RANGE BETWEEN 63115200 PRECEDING AND CURRENT ROW) - CAST(Hb_deferral AS INTEGER) AS INTEGER) AS recent_deferrals FROM joined""")
def _(t):
    return series.recent_deferrals(t.joined()).select("don_id", "recent_deferrals")


@query("tries_on_day", f"WITH {ATTEMPTS} SELECT don_id, count(*) OVER (PARTITION BY donor, dateonly) AS tries FROM attempts")
def _(t):
    from donorflow.operators.rules import tries_on_day

    return tries_on_day(t.attempts()).select("don_id", "tries")


@query("lifetime_count", f"WITH {DONATIONS} SELECT don_id, CAST(count(*) OVER (PARTITION BY donor) AS INTEGER) AS n FROM donations")
def _(t):
    return series.lifetime_count(t.donations(), name="n").select("don_id", "n")


@query("running_index", f"WITH {DONATIONS} SELECT don_id, row_number() {W} AS i FROM donations")
def _(t):
    return series.running_index(t.donations(), order=ORDER).select("don_id", "i")


@query("refresh_first_event", f"WITH {DONATIONS} SELECT don_id, dateonly = min(dateonly) OVER (PARTITION BY donor) AS first_event FROM donations WHERE donat_phleb = 'K'")
def _(t):
    return series.refresh_first_event(t.donations().filter("donat_phleb = 'K'")).select("don_id", "first_event")


@query("lag_covariates", f"WITH {DONATIONS} SELECT don_id, lag(Hb) {W} AS Hb, lag(volume_drawn) {W} AS volume_drawn FROM donations")
def _(t):
    return series.lag_covariates(t.donations(), ["Hb", "volume_drawn"], order=ORDER).select("don_id", "Hb", "volume_drawn")


@query("holdout_last_event", f"WITH {DONATIONS} SELECT don_id, CASE WHEN row_number() OVER (PARTITION BY donor ORDER BY date DESC, don_id DESC) = 1 THEN 'test' ELSE 'train' END AS split FROM donations")
def _(t):
    return series.holdout_last_event(t.donations(), order=ORDER).select("don_id", "split")


@query("first_measurements", f"WITH {JOINED} SELECT donor, age, volume_drawn, Hb FROM joined QUALIFY row_number() {W} = 1")
def _(t):
    return series.first_measurements(t.joined(), ["age", "volume_drawn", "Hb"], order=ORDER)


@query("donor_constants", f"WITH {JOINED} SELECT DISTINCT donor, segment, acctbal FROM joined")
def _(t):
    return series.donor_constants(t.joined(), ["segment", "acctbal"])


@query("dense_donor_index", f"WITH {DONATIONS} SELECT don_id, dense_rank() OVER (ORDER BY donor) AS idx FROM donations")
def _(t):
    return series.dense_donor_index(t.donations()).select("don_id", "idx")


@query("trim_after_last_deferral", f"""WITH {JOINED}, x AS (SELECT *, count(*) OVER (PARTITION BY donor) AS n, sum(CAST(Hb_deferral AS INTEGER)) OVER (PARTITION BY donor) AS hits, first_value(Hb_deferral) {W} AS f, row_number() {W} AS i FROM joined),
y AS (SELECT *, max(CASE WHEN Hb_deferral THEN i END) OVER (PARTITION BY donor) AS cut FROM x)
SELECT don_id FROM y WHERE n > 1 AND NOT (hits = 1 AND f) AND (cut IS NULL OR i <= cut)""")
def _(t):
    return series.trim_after_last_deferral(t.joined(), order=ORDER).select("don_id")


# ordering

@query("sort_by_time", f"WITH {DONATIONS} SELECT donor, don_id, dateonly FROM donations")
def _(t):
    return ordering.sort_by_time(t.donations().select("donor", "don_id", "dateonly"), ["dateonly", "don_id"])


@query("last_row_by_desc_date", f"WITH {DONATIONS} SELECT donor, don_id, Hb FROM donations QUALIFY row_number() OVER (PARTITION BY donor ORDER BY date DESC, don_id DESC) = 1")
def _(t):
    return ordering.last_row_by_desc_date(t.donations().select("donor", "don_id", "Hb", "clock"), order=ORDER).select("donor", "don_id", "Hb")


@query("min_row", f"WITH {DONATIONS} SELECT donor, don_id, volume_drawn FROM donations QUALIFY row_number() OVER (PARTITION BY donor ORDER BY volume_drawn, don_id) = 1")
def _(t):
    return ordering.min_row(t.donations().select("donor", "don_id", "volume_drawn"), ["donor"], ["volume_drawn", "don_id"])


@query("nearest_value", f"WITH {DONATIONS} SELECT don_id, Hb FROM donations ORDER BY abs(Hb - 151.5), don_id LIMIT 1")
def _(t):
    return ordering.nearest_value(t.donations().select("don_id", "Hb"), "Hb", 151.5, "don_id")


@query("ordered_levels", f"""WITH {DONATIONS}, x AS (SELECT donor, avg(CASE WHEN donat_phleb = 'K' THEN volume_drawn END) AS a, avg(CASE WHEN donat_phleb = '*' THEN volume_drawn END) AS b FROM donations GROUP BY donor)
SELECT donor, round(a, 6) AS first_mean, round(b, 6) AS second_mean, row_number() OVER (ORDER BY a DESC NULLS LAST, b DESC NULLS LAST, donor) AS level FROM x""")
def _(t):
    o = ordering.ordered_levels(t.donations(), "donor", "donat_phleb", "volume_drawn", "K", "*")
    return o.select("donor", r6("first_mean").alias("first_mean"), r6("second_mean").alias("second_mean"), "level")


@query("distributed_prefix_sum", f"""WITH {SCORES}, c AS (SELECT score, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM scores GROUP BY score)
SELECT score, CAST(sum(n) OVER (ORDER BY score) AS BIGINT) AS cum_n, CAST(sum(pos) OVER (ORDER BY score) AS BIGINT) AS cum_pos FROM c""")
def _(t):
    c = t.scores().groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    return ordering.distributed_prefix_sum(c, ["score"], ["n", "pos"]).select("score", "cum_n", "cum_pos")
