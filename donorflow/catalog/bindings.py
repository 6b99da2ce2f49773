"""The given tables seen as donations, donors, attempts, scores and draws.

Each binding exists twice: as a DataFrame, and as a common table expression for the SQL
that checks the queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorflow.functions import expr
from donorflow.plans.features import Settings, add_event_columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its equivalent SQL."""
    def keep(fn: Callable[["Tables"], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def r6(value: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


class Tables:
    """Lazy access to the tables of one scale factor."""

    def __init__(self, spark: SparkSession, folder: str):
        # the tables hold zone-less times; reading them as UTC is what the SQL does
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def donations(self) -> DataFrame:
        o = self.table("orders")
        minutes = F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(F.col("o_orderkey") * 7 % 1440)  # a fifth at midnight
        clock = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 60 * minutes
        return o.select(
            F.col("o_custkey").alias("donor"), F.col("o_orderkey").alias("don_id"),
            F.timestamp_seconds(clock).alias("date"), F.col("o_orderdate").cast("date").alias("dateonly"), clock.alias("clock"),
            F.when(F.col("o_orderpriority") < "4", "-").otherwise("X").alias("status"),
            expr.recode("o_orderstatus", {"F": "K", "O": "*"}, "H").alias("donat_phleb"),
            (F.col("o_orderkey") % 600).cast("int").alias("volume_drawn"),
            (100 + F.col("o_totalprice") / 5000).alias("Hb"),
        )

    def donors(self) -> DataFrame:
        c = self.table("customer")
        key = F.col("c_custkey")
        start = F.lit("1955-01-01").cast("date")
        return c.select(
            key.alias("donor"),
            F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("sex"),
            F.date_add(start, (key * 37 % 12000).cast("int")).alias("dob"),
            F.date_add(F.lit("1992-01-01").cast("date"), (key * 13 % 1500).cast("int")).alias("date_first_donation"),
            F.when(key % 7 != 0, key % 5).cast("int").alias("nb_donat_progesa"),
            (key % 3).cast("int").alias("nb_donat_outside"),
            F.when(key % 11 != 0, F.col("c_acctbal")).alias("FERRITIN_FIRST"),
            F.when(key % 13 != 0, F.col("c_acctbal") + 10).alias("FERRITIN_LAST"),
            F.date_add(F.lit("1999-06-01").cast("date"), (key * 17 % 900).cast("int")).alias("FERRITIN_LAST_DATE"),
            F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"),
            F.when(key % 25 < 16, "train").when(key % 25 < 20, "validate").otherwise("test").alias("label"),
        )

    def joined(self) -> DataFrame:
        """Donations with sex, age and deferral."""
        subjects = self.donors().withColumn("sex", expr.recode("sex", {"F": "female", "M": "male"}))
        rows = self.donations().drop("dateonly", "clock").join(subjects, "donor")
        return add_event_columns(rows, Settings())

    def raw_donations(self) -> DataFrame:
        d = self.donations()
        return d.select(
            F.col("don_id").alias("KEY_DONAT_INDEX_DON"), F.col("donor").alias("KEY_DONOR"),
            F.date_format("date", "yyyyMMdd").alias("KEY_DONAT_INDEX_DATE"),
            F.date_format("date", "HHmm").alias("DONAT_PHLEB_START"), F.col("status").alias("DONAT_STATUS"),
            F.col("donat_phleb").alias("KEY_DONAT_PHLEB"), F.col("volume_drawn").alias("DONAT_VOL_DRAWN"),
            F.col("Hb").alias("DONAT_RESULT_CODE"),
        )

    def raw_donors(self) -> DataFrame:
        d = self.donors()
        return d.select(
            F.col("donor").alias("KEY_DONOR"), F.col("sex").alias("KEY_DONOR_SEX"),
            F.date_format("dob", "yyyyMMdd").alias("KEY_DONOR_DOB"), "label",
        )

    def attempts(self) -> DataFrame:
        e = self.table("events")
        ts = F.col("ts").cast("timestamp")
        return e.select(
            F.col("user_id").alias("donor"), F.col("event_id").alias("don_id"), ts.alias("date"), ts.cast("date").alias("dateonly"),
            F.unix_timestamp(ts).alias("clock"),
            F.when(F.col("event_type").isin("click", "view"), "K").otherwise("*").alias("donat_phleb"),
            (100 + F.col("value") / 5).alias("Hb"), (F.col("value") < 20).alias("Hb_deferral"),
        )

    def scores(self) -> DataFrame:
        li = self.table("lineitem")
        return li.select(
            F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("id"),
            F.col("l_linestatus").alias("grp"),
            F.when(F.col("l_linestatus") == "F", "data-female-rf").otherwise("data-male-rf").alias("run"),
            (F.floor(F.col("l_extendedprice")) % 1000 / 1000).alias("score"), F.col("l_discount").alias("tied"),
            (F.col("l_returnflag") == "R").cast("int").alias("label"),
            (F.col("l_quantity") > 30).cast("int").alias("predicted"),
            (100 + F.col("l_quantity")).alias("original_value"), (110 + F.col("l_extendedprice") / 3000).alias("predicted_value"),
        )

    def draws(self, parameters: int | None = None) -> DataFrame:
        """Draws of all parameters, or of the first ``parameters``."""
        e = self.table("embeddings")
        values = F.col("embedding") if parameters is None else F.slice("embedding", 1, parameters)
        return e.select(F.col("vec_id").alias("draw"), F.posexplode(values).alias("position", "value")).select(
            F.format_string("p%02d", "position").alias("parameter"), "draw", F.col("value").cast("double").alias("value"),
            (F.col("draw") % 2 + 1).cast("int").alias("chain"),
        )


DONATIONS = """donations AS (
  SELECT o_custkey AS donor, o_orderkey AS don_id, o_orderdate + to_minutes(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey * 7 % 1440 END) AS date,
    CAST(o_orderdate AS DATE) AS dateonly, CAST(epoch(o_orderdate + to_minutes(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey * 7 % 1440 END)) AS BIGINT) AS clock,
    CASE WHEN o_orderpriority < '4' THEN '-' ELSE 'X' END AS status,
    CASE o_orderstatus WHEN 'F' THEN 'K' WHEN 'O' THEN '*' ELSE 'H' END AS donat_phleb,
    CAST(o_orderkey % 600 AS INTEGER) AS volume_drawn, 100 + o_totalprice / 5000 AS Hb
  FROM orders)"""
DONORS = """donors AS (
  SELECT c_custkey AS donor, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
    DATE '1955-01-01' + CAST(c_custkey * 37 % 12000 AS INTEGER) AS dob,
    DATE '1992-01-01' + CAST(c_custkey * 13 % 1500 AS INTEGER) AS date_first_donation,
    CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 5 AS INTEGER) END AS nb_donat_progesa,
    CAST(c_custkey % 3 AS INTEGER) AS nb_donat_outside,
    CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS FERRITIN_FIRST,
    CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal + 10 END AS FERRITIN_LAST,
    DATE '1999-06-01' + CAST(c_custkey * 17 % 900 AS INTEGER) AS FERRITIN_LAST_DATE,
    c_acctbal AS acctbal, c_mktsegment AS segment,
    CASE WHEN c_custkey % 25 < 16 THEN 'train' WHEN c_custkey % 25 < 20 THEN 'validate' ELSE 'test' END AS label
  FROM customer)"""
JOINED = DONATIONS + ",\n" + DONORS + """,
joined AS (
  SELECT d.donor, d.don_id, d.date, d.dateonly, d.clock, d.status, d.donat_phleb, d.volume_drawn, d.Hb,
    CASE WHEN p.sex = 'F' THEN 'female' ELSE 'male' END AS sex, p.dob, p.date_first_donation, p.nb_donat_progesa,
    p.nb_donat_outside, p.acctbal, p.segment, p.label, p.FERRITIN_FIRST, p.FERRITIN_LAST, p.FERRITIN_LAST_DATE,
    CAST(year(d.date) - year(p.dob) - CASE WHEN month(d.date) * 100 + day(d.date) < month(p.dob) * 100 + day(p.dob) THEN 1 ELSE 0 END AS INTEGER) AS age,
    d.Hb < CASE WHEN p.sex = 'F' THEN 125 ELSE 135 END AS Hb_deferral
  FROM donations d JOIN donors p ON d.donor = p.donor)"""
ATTEMPTS = """attempts AS (
  SELECT user_id AS donor, event_id AS don_id, ts AS date, CAST(ts AS DATE) AS dateonly, CAST(floor(epoch(ts)) AS BIGINT) AS clock,
    CASE WHEN event_type IN ('click', 'view') THEN 'K' ELSE '*' END AS donat_phleb, 100 + value / 5 AS Hb, value < 20 AS Hb_deferral
  FROM events)"""
SCORES = """scores AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_linestatus AS grp,
    CASE WHEN l_linestatus = 'F' THEN 'data-female-rf' ELSE 'data-male-rf' END AS run,
    (CAST(floor(l_extendedprice) AS BIGINT) % 1000) / 1000 AS score, l_discount AS tied,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS predicted,
    100 + l_quantity AS original_value, 110 + l_extendedprice / 3000 AS predicted_value
  FROM lineitem)"""
DRAWS = """draws AS (
  SELECT 'p' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS parameter, vec_id AS draw, CAST(embedding[i] AS DOUBLE) AS value,
    CAST(vec_id % 2 + 1 AS INTEGER) AS chain
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i))"""
# the exclusion chain, one filter per rule
CHAIN = JOINED + """,
s1 AS (SELECT * FROM joined WHERE CAST(date AS DATE) IS DISTINCT FROM dob),
s2 AS (SELECT * FROM s1 WHERE date IS NOT NULL AND dob IS NOT NULL),
s3 AS (SELECT * FROM s2 WHERE dateonly <> DATE '1939-01-01'),
s4 AS (SELECT * FROM s3 WHERE age >= 18),
s5 AS (SELECT * FROM s4 WHERE Hb IS NOT NULL),
s6 AS (SELECT * FROM s5 QUALIFY date = max(date) OVER (PARTITION BY donor, dateonly)),
s7 AS (SELECT *, dateonly = min(dateonly) OVER (PARTITION BY donor) AS first_event,
  CASE WHEN (donat_phleb = 'K' AND status = '-') OR (donat_phleb = 'K' AND status <> '-' AND volume_drawn > 100)
    OR (donat_phleb = 'H' AND volume_drawn > 100) THEN dateonly END AS fb FROM s6),
s8 AS (SELECT *, CAST(dateonly - last_value(fb IGNORE NULLS) OVER (PARTITION BY donor ORDER BY date, don_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS days_to_previous_fb FROM s7),
s9 AS (SELECT * FROM s8 WHERE donat_phleb IN ('K', '*')),
s10 AS (SELECT * FROM s9 QUALIFY bool_or(first_event) OVER (PARTITION BY donor)),
s11 AS (SELECT * FROM s10 WHERE first_event OR (days_to_previous_fb IS NOT NULL AND Hb IS NOT NULL))"""
FEATURES = CHAIN + """,
g1 AS (SELECT *, CAST(Hb_deferral AS INTEGER) AS low, CASE WHEN donat_phleb = 'K' THEN 1 ELSE 0 END AS whole,
  hour(date) + minute(date) / 60.0 AS h,
  sum(CAST(Hb_deferral AS INTEGER)) OVER (PARTITION BY donor ORDER BY date, don_id ROWS UNBOUNDED PRECEDING) AS c FROM s11),
g2 AS (SELECT *, last_value(CASE WHEN NOT Hb_deferral THEN c END IGNORE NULLS) OVER (PARTITION BY donor ORDER BY date, don_id ROWS UNBOUNDED PRECEDING) AS c0 FROM g1),
features AS (SELECT don_id, donor, Hb, dateonly, clock, lag(Hb_deferral) OVER w AS previous_Hb_def, days_to_previous_fb, donat_phleb, sex, age,
  Hb_deferral, CAST(count(*) OVER (PARTITION BY donor) AS INTEGER) AS nb_donat_progesa, 0 AS nb_donat_outside, first_event,
  lag(Hb, 1, 0.0) OVER w AS previous_Hb, CAST(year(dateonly) AS INTEGER) AS year, CASE WHEN month(dateonly) BETWEEN 4 AND 9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS warm_season,
  first_value(Hb) OVER w AS Hb_first, CASE WHEN h = 0 THEN (SELECT avg(h) FROM g1 WHERE h <> 0) ELSE h END AS hour,
  CAST(lag(c - coalesce(c0, 0), 1, 0) OVER w AS INTEGER) AS consecutive_deferrals,
  CAST(sum(whole) OVER (PARTITION BY donor ORDER BY clock RANGE BETWEEN 157788000 PRECEDING AND CURRENT ROW) - whole AS INTEGER) AS recent_donations,
  lag(Hb, 2) OVER w AS previous_Hb2, lag(Hb, 3) OVER w AS previous_Hb3, lag(Hb, 4) OVER w AS previous_Hb4, lag(Hb, 5) OVER w AS previous_Hb5,
  CAST(dateonly - lag(dateonly, 1) OVER w AS INTEGER) AS days_to_previous_Hb, CAST(dateonly - lag(dateonly, 2) OVER w AS INTEGER) AS days_to_previous_Hb2,
  CAST(dateonly - lag(dateonly, 3) OVER w AS INTEGER) AS days_to_previous_Hb3, CAST(dateonly - lag(dateonly, 4) OVER w AS INTEGER) AS days_to_previous_Hb4,
  CAST(dateonly - lag(dateonly, 5) OVER w AS INTEGER) AS days_to_previous_Hb5,
  CAST(sum(low) OVER (PARTITION BY donor ORDER BY clock RANGE BETWEEN 63115200 PRECEDING AND CURRENT ROW) - low AS INTEGER) AS recent_deferrals, label
  FROM g2 WINDOW w AS (PARTITION BY donor ORDER BY date, don_id))"""
SWEEP = SCORES + """,
cells AS (SELECT score AS threshold, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scores GROUP BY score),
sweep AS (SELECT threshold, pos, neg, CAST(sum(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp,
  CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N FROM cells)"""
SWEEP = SWEEP.replace(" AS P,", " AS npos,").replace(" AS N FROM", " AS nneg FROM")
GSWEEP = SCORES + """,
cells AS (SELECT grp, tied AS threshold, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scores GROUP BY grp, tied),
sweep AS (SELECT grp, threshold, pos, neg, CAST(sum(pos) OVER (PARTITION BY grp ORDER BY threshold DESC) AS BIGINT) AS tp,
  CAST(sum(neg) OVER (PARTITION BY grp ORDER BY threshold DESC) AS BIGINT) AS fp,
  CAST(sum(pos) OVER (PARTITION BY grp) AS BIGINT) AS npos, CAST(sum(neg) OVER (PARTITION BY grp) AS BIGINT) AS nneg FROM cells)"""
