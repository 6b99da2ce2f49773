"""Attributions, posterior effects and the cost model."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorflow.catalog.bindings import DONATIONS, DRAWS, JOINED, SCORES, query, r6
from donorflow.catalog.evaluating import cost_sql
from donorflow.catalog.modeling import VARIABLES, last_events
from donorflow.functions import cost
from donorflow.functions.metadata import variable_table
from donorflow.operators import explain, models, posterior, shape
from donorflow.session import reliable_checkpoint


COEF = {"Hb": -0.05, "volume_drawn": 0.002}


@query("shap_linear_exact", f"""WITH {DONATIONS} SELECT don_id, 'Hb' AS "Variable", round(-0.05 * (Hb - avg(Hb) OVER ()), 6) AS attribution FROM donations UNION ALL SELECT don_id, 'volume_drawn', round(0.002 * (volume_drawn - avg(volume_drawn) OVER ()), 6) FROM donations""")
def _(t):
    return explain.shap_linear_exact(t.donations(), COEF, "don_id").withColumn("attribution", r6("attribution"))


_SHAP = f"""{DONATIONS}, phi AS (SELECT don_id, 'Hb' AS v, -0.05 * (Hb - avg(Hb) OVER ()) AS a, Hb AS x FROM donations UNION ALL SELECT don_id, 'volume_drawn', 0.002 * (volume_drawn - avg(volume_drawn) OVER ()), volume_drawn FROM donations),
long AS (SELECT v, a, (x - avg(x) OVER (PARTITION BY v)) / stddev_samp(x) OVER (PARTITION BY v) AS z FROM phi)"""


@query("shap_long", f'WITH {_SHAP} SELECT v AS "Variable", round(a, 6) AS attribution, round(z, 6) AS value FROM long')
def _(t):
    d = t.donations()
    long = explain.shap_long(explain.shap_linear_exact(d, COEF, "don_id"), d, list(COEF), "don_id", seed=3)
    return long.select("Variable", r6("attribution").alias("attribution"), r6("value").alias("value"))


@query("shap_summary", f"""WITH {_SHAP}, flat AS (SELECT 'day' AS v, 0.0::DOUBLE AS a, NULL::DOUBLE AS z FROM donations), every AS (SELECT * FROM long UNION ALL SELECT * FROM flat)
SELECT 'mean' AS kind, v AS "Variable", CASE v WHEN 'Hb' THEN 'Hemoglobin' END AS "Pretty", round(avg(abs(a)), 6) AS attribution, NULL::DOUBLE AS value FROM every GROUP BY v
UNION ALL SELECT 'point', v, NULL, round(a, 6), CASE WHEN abs(z) <= 1.5 THEN round(z, 6) END FROM long""")
def _(t):
    """Means of all variables, and the points to show: a variable without effect has none, far values are NULL."""
    d = t.donations()
    long = explain.shap_long(explain.shap_linear_exact(d, COEF, "don_id"), d, list(COEF), "don_id")
    long = long.unionByName(d.select(F.lit("day").alias("Variable"), F.lit(0.0).alias("attribution"), F.lit(None).cast("double").alias("value")))
    means = explain.shap_summary(long, variable_table(t.spark)).select(F.lit("mean").alias("kind"), "Variable", "Pretty", r6("attribution").alias("attribution"))
    points = explain.shap_points(long, 1.5).select(F.lit("point").alias("kind"), "Variable", r6("attribution").alias("attribution"), r6("value").alias("value"))
    return means.unionByName(points, allowMissingColumns=True)


@query("shap_sampling")
def _(t):
    rows = reliable_checkpoint(last_events(t))
    numeric = rows.withColumns({c: F.col(c).cast("double") for c in VARIABLES})
    model = models.random_forest(rows, VARIABLES, trees=100, depth=4)
    return explain.shap_sampling(model.predict, numeric, VARIABLES, "don_id")


@query("permutation_importance")
def _(t):
    rows = reliable_checkpoint(models.numeric_label(last_events(t)))
    model = models.random_forest(rows, VARIABLES, trees=100, depth=4)
    return explain.permutation_importance(model.predict, rows, VARIABLES, "label_index", "don_id")


_HDI = """s AS (SELECT parameter, value, row_number() OVER (PARTITION BY parameter ORDER BY value, draw) AS i, count(*) OVER (PARTITION BY parameter) AS n FROM base),
w AS (SELECT a.parameter, a.i, a.value AS low, b.value AS high, b.value - a.value AS width FROM s a JOIN s b ON a.parameter = b.parameter AND b.i = a.i + CAST(ceil(0.95::DOUBLE * a.n) AS BIGINT)),
m AS (SELECT parameter, min(i) AS a, max(i) AS b, count(*) AS c FROM w WHERE width = (SELECT min(width) FROM w w2 WHERE w2.parameter = w.parameter) GROUP BY parameter),
pick AS (SELECT parameter, CASE WHEN b - a + 1 = c THEN (a + b) // 2 ELSE b END AS i FROM m),
mu AS (SELECT parameter, avg(value) AS mean FROM base GROUP BY parameter)
SELECT mu.parameter, round(mean, 6) AS mean, low, high FROM mu JOIN pick ON mu.parameter = pick.parameter JOIN w ON w.parameter = pick.parameter AND w.i = pick.i"""


@query("posterior_effects", f"WITH {DRAWS}, base AS (SELECT * FROM draws), {_HDI}")
def _(t):
    return posterior.posterior_effects(t.draws()).withColumn("mean", r6("mean"))


@query("combine_posteriors", f"""WITH {DRAWS}, base AS (SELECT parameter, 'a-' || draw AS draw, value FROM draws WHERE chain = 1 UNION ALL SELECT parameter, 'b-' || draw, value FROM draws WHERE chain = 2), {_HDI}""")
def _(t):
    d = t.draws()
    return posterior.combine_posteriors({"a": d.filter("chain = 1"), "b": d.filter("chain = 2")}).withColumn("mean", r6("mean"))


@query("parameter_cis", f"""WITH {DRAWS}, s AS (SELECT parameter, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n, count(*) - 1 AS v FROM draws GROUP BY parameter),
t AS (SELECT *, (1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4 * v) + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96 * v * v)) * s / sqrt(n) AS h FROM s)
SELECT parameter, round(m, 3) AS mean, round(m - h, 3) AS low, round(m + h, 3) AS high FROM t""")
def _(t):
    return posterior.parameter_cis(t.draws())


@query("rhat", f"""WITH {DRAWS}, h AS (SELECT *, CASE WHEN draw <= floor(max(draw) OVER (PARTITION BY parameter, chain) / 2) THEN 1 ELSE 2 END AS half FROM draws),
p AS (SELECT parameter, chain, half, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM h GROUP BY ALL),
o AS (SELECT parameter, avg(v) AS w, var_samp(m) AS b, avg(n) AS n FROM p GROUP BY parameter)
SELECT parameter, round(sqrt(((n - 1) / n * w + b) / w), 6) AS rhat FROM o""")
def _(t):
    return posterior.rhat(t.draws()).withColumn("rhat", r6("rhat"))


@query("effect_size_by_sex", f"""WITH {JOINED}, e AS (SELECT segment, sex, min(Hb) AS low, max(Hb) AS high, (min(Hb) + max(Hb)) / 2 AS mean FROM joined GROUP BY segment, sex),
v AS (SELECT segment, row_number() OVER (ORDER BY segment) AS place FROM (SELECT DISTINCT segment FROM joined)),
i AS (SELECT segment, CAST(count(*) AS DOUBLE) AS imp FROM joined WHERE segment <> 'MACHINERY' GROUP BY segment)
SELECT v.segment AS "Pretty", place, round(mean, 5) AS mean, low, high, sex, 'Regression coefficient' AS method FROM v JOIN e ON e.segment = v.segment
UNION ALL SELECT v.segment, place, imp, 0.0, imp, 'both', 'Importance' FROM v JOIN i ON i.segment = v.segment""")
def _(t):
    from donorflow.operators.ordered import row_ranks

    j = t.joined()
    e = j.groupBy(F.col("segment").alias("Pretty"), "sex").agg(F.min("Hb").alias("low"), F.max("Hb").alias("high")).withColumn("mean", (F.col("low") + F.col("high")) / 2)
    importance = j.filter("segment <> 'MACHINERY'").groupBy(F.col("segment").alias("Pretty")).agg(F.count(F.lit(1)).cast("double").alias("Importance"))
    variables = row_ranks(j.select(F.col("segment").alias("Pretty")).distinct(), "Pretty", name="place")
    male, female = (e.filter(F.col("sex") == s).drop("sex") for s in ("male", "female"))
    out = posterior.effect_size_by_sex(male, female, importance, variables)
    return out.withColumn("mean", F.round("mean", 5))


# cost model

_POINTS = f"""{SCORES}, pts AS (SELECT DISTINCT 1 + round(score, 2) AS a, tied AS q FROM scores)"""


def points(t):
    return t.scores().select((1 + F.round("score", 2)).alias("a"), F.col("tied").alias("q")).distinct()


def _cost(a, q, form="new"):
    if form == "simplified":
        return f"(2.0 / ((1 - 0.1066) / {a} + 0.1066) - 2.0 - 60.0 * 0.03269718 * {q})"
    scale = "(1 - 0.1066) * " if form == "new" else ""
    return f"(2.0 * ({a} / (1 + 0.1066 * ({a} - 1)) - 1 - {scale}0.03269718 * {q} * 0.1) - 60.0 * 0.03269718 * {q})"


@query("economic_cost", f"""WITH {_POINTS} SELECT a, q, round({_cost('a', 'q')}, 6) AS new, round({_cost('a', 'q', 'old')}, 6) AS old, round({_cost('a', 'q', 'simplified')}, 6) AS simple FROM pts""")
def _(t):
    def e(form):
        return r6(cost.economic_cost("q", "a", rloss=0.1, form=form))

    return points(t).select("a", "q", e("new").alias("new"), e("old").alias("old"), e("simplified").alias("simple"))


def _extension_sql():
    parts = []
    for sex in ("male", "female", "both"):
        for months in (6, 12):
            q, a, e = cost_sql(months, "tpr", "fpr", f"'{sex}'")
            parts.append(f"SELECT '{sex}' AS sex, {months} AS months, grp, tied, round({q}, 6) AS q, round({a}, 6) AS a, round({e}, 6) AS e FROM r")
    return f"""WITH {SCORES}, r AS (SELECT grp, tied, avg(label) AS tpr, avg(predicted) AS fpr FROM scores GROUP BY grp, tied) """ + " UNION ALL ".join(parts)


@query("interval_extension", _extension_sql())
def _(t):
    rates = t.scores().groupBy("grp", "tied").agg(F.avg("label").alias("tpr"), F.avg("predicted").alias("fpr"))
    parts = {}
    for sex in ("male", "female", "both"):
        for months in (6, 12):
            x = cost.interval_extension("tpr", "fpr", months, sex)
            parts[f"{sex}{months}"] = rates.select(F.lit(sex).alias("sex"), F.lit(months).alias("months"), "grp", "tied", r6(x["q"]).alias("q"), r6(x["a"]).alias("a"), r6(x["E"]).alias("e"))
    return shape.multi_source_bind(parts, "part").drop("part")


@query("cost_surface", f"""WITH {SCORES}, a AS (SELECT DISTINCT 1 + round(score, 2) AS a FROM scores), q AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS q)
SELECT a, round(q / 0.032, 6) AS q, round({_cost('a', 'CAST(q AS DOUBLE)', 'simplified')}, 6) AS "E" FROM a, q""")
def _(t):
    axis = t.scores().select((1 + F.round("score", 2)).alias("a")).distinct()
    s = cost.cost_surface(shape.grid_expand(axis, {"q": [0.0, 0.25, 0.5, 0.75, 1.0]}), "a", "q", rescale=0.032)
    return s.select("a", r6("q").alias("q"), r6("E").alias("E"))


@query("cost_gradient", f"""WITH {_POINTS}, x AS (SELECT a, q, a - 1 AS loss, 1 + 0.1066 * (a - 1) AS slow, 0.03269718::DOUBLE AS d FROM pts)
SELECT a, q, round(-60 * d - 2 * (1 - 0.1066) * d * loss, 5) AS d_q, round(2 * (1 - 0.1066) / pow(slow, 2), 5) AS d_atot, round(a / slow - 1 - (1 - 0.1066) * d * q * loss, 5) AS "d_Pm", round(-d * q, 5) AS "d_Pd",
 round(2 * a * 0.1066 * (a - 1) / pow(slow, 2), 5) AS "d_F", round(2 * (d * q * loss - a * (a - 1) / pow(slow, 2)), 5) AS "d_Fn", round(-2 * (1 - 0.1066) * d * q, 5) AS d_rloss FROM x""")
def _(t):
    g = cost.cost_gradient(points(t).withColumn("loss", F.col("a") - 1), {"q": "q", "atot": "a", "Pm": 2.0, "Pd": 60.0, "F": 1.0, "Fn": 0.1066, "rloss": "loss"})
    return g.select("a", "q", *[r6(c, 5).alias(c) for c in ("d_q", "d_atot", "d_Pm", "d_Pd", "d_F", "d_Fn", "d_rloss")])
