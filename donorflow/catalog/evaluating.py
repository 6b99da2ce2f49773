"""Evaluation of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorflow.catalog.bindings import GSWEEP, SCORES, SWEEP, query, r6
from donorflow.functions.metadata import COST_CONSTANTS
from donorflow.operators import metrics

F1 = "2.0 * tp / (2 * tp + fp + (npos - tp))"
YOUDEN = "tp / npos + (nneg - fp) / nneg"


def sweep_of(t):
    return metrics.threshold_sweep(t.scores())


def grouped(t):
    return metrics.threshold_sweep(t.scores(), "tied", "label", ["grp"])


@query("threshold_sweep", f"WITH {GSWEEP} SELECT grp, threshold, tp, fp, npos - tp AS fn, nneg - fp AS tn FROM sweep")
def _(t):
    return grouped(t).select("grp", "threshold", "tp", "fp", "fn", "tn")


def _cut(goal, name, extra=""):
    return f"""WITH {SWEEP}, g AS (SELECT *, {goal} AS goal FROM sweep), top AS (SELECT * FROM g WHERE goal = (SELECT max(goal) FROM g))
SELECT round(median(threshold), 6) AS threshold, round(max(goal), 6) AS {name}{extra} FROM top"""


@query("optimal_f1_cut", _cut(F1, "f1", ", round(arg_max(tp / npos, threshold), 6) AS sensitivity, round(arg_max((nneg - fp) / nneg, threshold), 6) AS specificity"))
def _(t):
    c = metrics.optimal_f1_cut(sweep_of(t))
    return c.select(*[r6(n).alias(n) for n in ("threshold", "f1", "sensitivity", "specificity")])


@query("optimal_youden_cut", f"""WITH {SCORES}, cells AS (SELECT predicted_value AS threshold, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scores GROUP BY predicted_value),
sweep AS (SELECT threshold, CAST(sum(pos) OVER (ORDER BY threshold) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY threshold) AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS npos, CAST(sum(neg) OVER () AS BIGINT) AS nneg FROM cells),
g AS (SELECT *, {YOUDEN} AS goal FROM sweep)
SELECT round(median(threshold), 6) AS threshold, round(max(goal), 6) AS sum_sens_spec FROM g WHERE goal = (SELECT max(goal) FROM g)""")
def _(t):
    s = metrics.threshold_sweep(t.scores(), "predicted_value", "label", (), "<=")
    c = metrics.optimal_youden_cut(s)
    return c.select(r6("threshold").alias("threshold"), r6("sum_sens_spec").alias("sum_sens_spec"))


@query("apply_threshold", f"WITH {SCORES} SELECT id, CASE WHEN score >= 0.35 THEN 1 ELSE 0 END AS hit, 0.35::DOUBLE AS f1_threshold FROM scores")
def _(t):
    return metrics.apply_threshold(t.scores(), "score", 0.35, "hit").select("id", "hit", "f1_threshold")


@query("confusion_matrix", f"""WITH {SCORES} SELECT o AS observed, p AS predicted, (SELECT count(*) FROM scores WHERE label = o AND predicted = p) AS n FROM (VALUES (0), (1)) AS a(o), (VALUES (0), (1)) AS b(p)""")
def _(t):
    return metrics.confusion_matrix(t.scores(), "label", "predicted")


@query("tpr_fpr", f"""WITH {SCORES} SELECT grp, round(count(*) FILTER (score >= 0.35 AND label = 1) / count(*) FILTER (label = 1), 6) AS "TPR", round(count(*) FILTER (score >= 0.35 AND label = 0) / count(*) FILTER (label = 0), 6) AS "FPR" FROM scores GROUP BY grp""")
def _(t):
    return metrics.tpr_fpr(t.scores(), "score", "label", 0.35, ["grp"]).select("grp", r6("TPR").alias("TPR"), r6("FPR").alias("FPR"))


@query("rates_from_labels", f"""WITH {SCORES} SELECT round(count(*) FILTER (predicted = 1 AND label = 1) / count(*) FILTER (label = 1), 6) AS "TPR", round(count(*) FILTER (predicted = 1 AND label = 0) / count(*) FILTER (label = 0), 6) AS "FPR" FROM scores""")
def _(t):
    s = t.scores()
    r = metrics.rates_from_labels([s.filter("grp = 'F'"), s.filter("grp <> 'F'")], "label", "predicted")
    return r.select(r6("TPR").alias("TPR"), r6("FPR").alias("FPR"))


@query("roc_curve", f"WITH {SWEEP} SELECT threshold, round(fp / nneg, 6) AS fpr, round(tp / npos, 6) AS tpr FROM sweep")
def _(t):
    return metrics.roc_curve(sweep_of(t)).select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("auroc", f"WITH {GSWEEP} SELECT grp, round(sum(neg * (tp - 0.5 * pos)) / max(npos) / max(nneg), 6) AS auroc FROM sweep GROUP BY grp")
def _(t):
    return metrics.auroc(grouped(t), ["grp"]).select("grp", r6("auroc").alias("auroc"))


@query("auroc_ci", f"""WITH {SWEEP}, p AS (SELECT *, (nneg - fp + 0.5 * neg) / nneg AS below, (tp - 0.5 * pos) / npos AS above FROM sweep),
s AS (SELECT max(npos) AS np, max(nneg) AS nn, sum(pos * below) AS x1, sum(pos * below * below) AS x2, sum(neg * above) AS y1, sum(neg * above * above) AS y2 FROM p),
v AS (SELECT x1 / np AS a, sqrt((x2 - x1 * x1 / np) / (np - 1) / np + (y2 - y1 * y1 / nn) / (nn - 1) / nn) AS se FROM s)
SELECT round(a - 1.959963984540054 * se, 6) AS low, round(a, 6) AS value, round(a + 1.959963984540054 * se, 6) AS high FROM v""")
def _(t):
    return metrics.auroc_ci(sweep_of(t)).select(*[r6(n).alias(n) for n in ("low", "value", "high")])


@query("pr_curve", f"WITH {SWEEP} SELECT threshold, round(tp / npos, 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(npos / (npos + nneg), 6) AS baseline FROM sweep")
def _(t):
    return metrics.pr_curve(sweep_of(t)).select("threshold", *[r6(n).alias(n) for n in ("recall", "precision", "baseline")])


@query("aupr", f"""WITH {SWEEP}, x AS (SELECT pos, npos, tp - pos AS t0, CAST(fp - neg + tp - pos AS DOUBLE) AS s0, 1 + neg / nullif(pos, 0) AS h FROM sweep)
SELECT round(sum(CASE WHEN pos = 0 THEN 0 WHEN s0 = 0 THEN pos / h ELSE pos / h + (t0 - s0 / h) / h * ln((s0 + h * pos) / s0) END) / max(npos), 6) AS aupr FROM x""")
def _(t):
    return metrics.aupr(sweep_of(t)).select(r6("aupr").alias("aupr"))


@query("f1_score", f"""WITH {SCORES} SELECT grp, round(2.0 * count(*) FILTER (score >= 0.35 AND label = 1) / (count(*) FILTER (score >= 0.35) + count(*) FILTER (label = 1)), 6) AS f1 FROM scores GROUP BY grp""")
def _(t):
    return metrics.f1_score(t.scores(), "score", "label", 0.35, ["grp"]).select("grp", r6("f1").alias("f1"))


@query("mae_rmse", f"""WITH {SCORES}, e AS (SELECT grp, avg(abs(original_value - predicted_value)) AS m, sqrt(avg(pow(original_value - predicted_value, 2))) AS r FROM scores GROUP BY grp)
SELECT grp, round(m, 6) AS mae, round(r, 6) AS rmse, round(m * 0.06204, 6) AS mae_mmol, round(r * 0.06204, 6) AS rmse_mmol FROM e""")
def _(t):
    m = metrics.mae_rmse(t.scores(), "original_value", "predicted_value", ["grp"])
    return m.select("grp", *[r6(n).alias(n) for n in ("mae", "rmse", "mae_mmol", "rmse_mmol")])


@query("calibration_bins", f"""WITH {SCORES}, b AS (SELECT grp, CAST(ceil(tied * 10) AS INTEGER) AS bin, avg(label) AS rate, count(*) AS n FROM scores WHERE tied > 0 AND tied <= 1 GROUP BY ALL),
d AS (SELECT DISTINCT grp, CAST(bin AS INTEGER) AS bin FROM scores, (SELECT unnest(range(1, 11)) AS bin))
SELECT d.grp, d.bin, round(rate, 6) AS rate, coalesce(n, 0) AS "count" FROM d LEFT JOIN b ON d.grp = b.grp AND d.bin = b.bin""")
def _(t):
    return metrics.calibration_bins(t.scores(), "tied", "label", ["grp"]).withColumn("rate", r6("rate"))


@query("dummy_classifiers", f"""WITH {SCORES}, p AS (SELECT avg(label) AS p FROM scores)
SELECT id, round(p, 6) AS prior, CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS most_frequent, 1.0::DOUBLE AS deferred FROM scores, p""")
def _(t):
    s = t.scores().select("id", "label")
    for kind in ("prior", "most_frequent", "deferred"):
        s = metrics.dummy_classifiers(s, kind, "label", name=kind)
    return s.select("id", r6("prior").alias("prior"), "most_frequent", "deferred")


REPLICATES = 2000
_W = "4294967295"


def _mixed(rows, out, start):
    """Rows of a query and the mixing function of 32-bit words, as in operators/resampling.py, of one expression."""
    steps = [start, "xor(x, x >> 16)", "(x * 2146121005::UBIGINT) & 4294967295", "xor(x, x >> 15)", "(x * 2221713035::UBIGINT) & 4294967295", "xor(x, x >> 16)"]
    for i, step in enumerate(steps):
        keep = "*" if i == 0 else "* EXCLUDE (x)"
        rows = f"(SELECT {keep}, CAST({step} AS UBIGINT) AS {out if i == len(steps) - 1 else 'x'} FROM {rows})"
    return rows


def _uniform(rows, out, stream):
    """Rows with salt and place (both UBIGINT, place below 2^32) and the replicate r, and a number in (0, 1)."""
    a, b, c, d, e = (f"{out}_{n}" for n in "abcde")
    rows = _mixed(rows, a, f"(salt + {stream} * 2654435769) & {_W}")
    rows = _mixed(_mixed(rows, b, f"xor(place, {a})"), b + "2", b)
    rows = _mixed(_mixed(rows, c, f"(place + {a} + 1013904242) & {_W}"), c + "2", c)
    spread = f"(SELECT *, CAST(unnest(range(1, {REPLICATES + 1})) AS UBIGINT) AS r FROM {rows})" if stream < 2 else rows
    rows = _mixed(_mixed(spread, d, f"({c}2 + ((r * 2654435769::UBIGINT) & {_W})) & {_W}"), e, f"xor({b}2, {d})")
    return f"(SELECT * EXCLUDE ({a}, {b}, {b}2, {c}, {c}2, {d}, {e}), ({e} + 0.5::DOUBLE) / 4294967296 AS {out} FROM {rows})"


def _table(name, rows, ratio):
    """Cumulative chances of the values least .. most for each key of rows (key, least, most, ...), each with the chance of smaller ones."""
    return f"""{name}0 AS (SELECT *, CAST(unnest(range(least, most + 1)) AS BIGINT) AS k FROM {rows}),
{name}1 AS (SELECT *, sum(CASE WHEN k = least THEN 0 ELSE ln({ratio}) END) OVER (PARTITION BY key ORDER BY k) AS lg FROM {name}0),
{name}2 AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY key)) AS w FROM {name}1),
{name} AS (SELECT key, k, coalesce(sum(w) OVER (PARTITION BY key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY key) AS low FROM {name}2)"""


def _salt(group):
    return f"CAST(('0x' || substr(md5('1|' || {group}), 1, 8)) AS UBIGINT)"


def _weights(group):
    """wt: Poisson weights of every distinct score of a group in every replicate, with the sums up to it from the largest score."""
    drawn = _uniform(_uniform("placed", "up", 1), "un", 2)
    return f"""counted AS (SELECT {group} AS g, score AS threshold, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scores GROUP BY ALL),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY threshold DESC) - 1 AS UBIGINT) AS place, {_salt('g')} AS salt FROM counted),
means AS (SELECT DISTINCT c AS key, greatest(0, c - CAST(ceil(12 * sqrt(c)) AS BIGINT) - 20) AS least, c + CAST(ceil(12 * sqrt(c)) AS BIGINT) + 20 AS most FROM (SELECT pos AS c FROM counted UNION ALL SELECT neg FROM counted) WHERE c > 0),
{_table('poisson', 'means', 'key / k')},
drawn AS (SELECT * FROM {drawn}),
wt0 AS (SELECT d.g, d.r, d.threshold, d.place, d.pos AS pos0, d.neg AS neg0, coalesce(a.k, 0) AS pos, coalesce(b.k, 0) AS neg FROM drawn d ASOF LEFT JOIN poisson a ON d.pos = a.key AND d.up >= a.low ASOF LEFT JOIN poisson b ON d.neg = b.key AND d.un >= b.low),
wt AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY g, r) AS np, sum(neg) OVER (PARTITION BY g, r) AS nn,
 sum(pos0) OVER (PARTITION BY g, r) AS np0, sum(neg0) OVER (PARTITION BY g, r) AS nn0 FROM wt0 WINDOW w AS (PARTITION BY g, r ORDER BY place ROWS UNBOUNDED PRECEDING))"""


def _areas(name, rows, keys):
    """Areas of sweeps: rows have pos, neg, tp, fp, np and nn as DOUBLE."""
    return f"""{name}_x AS (SELECT *, tp - pos AS t0, tp - pos + fp - neg AS s0, 1 + neg / nullif(pos, 0) AS h FROM {rows}),
{name} AS (SELECT {keys}, sum(CASE WHEN pos = 0 THEN 0 WHEN s0 <= 0 THEN pos / h ELSE pos / h + (t0 - s0 / h) / h * ln((s0 + h * pos) / s0) END) / max(np) AS aupr,
 sum(pos * (nn - fp + 0.5 * neg)) / max(np) / max(nn) AS auroc FROM {name}_x GROUP BY {keys})"""


def _scaled(stratified):
    if not stratified:
        return "SELECT g, r, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(np AS DOUBLE) AS np, CAST(nn AS DOUBLE) AS nn FROM wt"
    return "SELECT g, r, pos * np0 / np AS pos, neg * nn0 / nn AS neg, tp * np0 / np AS tp, fp * nn0 / nn AS fp, CAST(np0 AS DOUBLE) AS np, CAST(nn0 AS DOUBLE) AS nn FROM wt"


POINT = """point0 AS (SELECT g, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,
 CAST(sum(pos) OVER (PARTITION BY g) AS DOUBLE) AS np, CAST(sum(neg) OVER (PARTITION BY g) AS DOUBLE) AS nn FROM counted WINDOW w AS (PARTITION BY g ORDER BY threshold DESC)),
""" + _areas("point", "point0", "g")


def _binomials(group, cut):
    """f1: F1 of every replicate that keeps both class sizes, and f1v: its value."""
    drawn = _uniform("(SELECT *, CAST(i AS UBIGINT) AS place FROM pairs)", "u", 0)
    return f"""four AS (SELECT {group} AS g, {_salt(group)} AS salt, count(*) FILTER (score >= {cut} AND label = 1) AS tp, count(*) FILTER (score < {cut} AND label = 1) AS fn,
 count(*) FILTER (score >= {cut} AND label = 0) AS fp, count(*) FILTER (score < {cut} AND label = 0) AS tn FROM scores GROUP BY ALL),
pairs AS (SELECT g, salt, 0 AS i, tp + fn AS n, tp AS s FROM four UNION ALL SELECT g, salt, 1, fp + tn, fp FROM four),
spans AS (SELECT DISTINCT g || '|' || i AS key, n, s, greatest(0, s - reach) AS least, least(n, s + reach) AS most FROM (SELECT *, CAST(ceil(12 * sqrt(s * (n - s) / n)) AS BIGINT) + 20 AS reach FROM pairs)),
{_table('binomial', 'spans', '(n - k + 1) / k * (s / (n - s))')},
cell AS (SELECT d.g, d.r, d.i, d.n, b.k FROM {drawn} d ASOF JOIN binomial b ON d.g || '|' || d.i = b.key AND d.u >= b.low),
f1 AS (SELECT g, r, 2.0::DOUBLE * max(k) FILTER (i = 0) / (max(k) FILTER (i = 0) + max(k) FILTER (i = 1) + max(n) FILTER (i = 0)) AS v FROM cell GROUP BY g, r),
f1v AS (SELECT g, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS v FROM four)"""


def _bounds(value, mean, sd):
    return f"round(2 * {value} - {mean} - 1.959963984540054 * {sd}, 6) AS low, round(2 * {value} - {mean} + 1.959963984540054 * {sd}, 6) AS high"


@query("bootstrap_ci", f"""WITH {SCORES}, {_weights('grp')}, {_areas('rep', f'({_scaled(True)})', 'g, r')}, {POINT}, {_binomials('grp', 0.35)}
SELECT g AS grp, 'AUPR' AS variable, round(max(p.aupr), 6) AS "value", {_bounds('max(p.aupr)', 'avg(rep.aupr)', 'stddev_samp(rep.aupr)')} FROM rep JOIN point p USING (g) GROUP BY g
UNION ALL SELECT g, 'F1', round(max(f1v.v), 6), {_bounds('max(f1v.v)', 'avg(f1.v)', 'stddev_samp(f1.v)')} FROM f1 JOIN f1v USING (g) GROUP BY g""")
def _(t):
    parts = [metrics.bootstrap_ci(t.scores(), s, by=["grp"], threshold=0.35, replicates=REPLICATES) for s in ("f1", "aupr")]
    return parts[0].unionByName(parts[1]).select("grp", "variable", *[r6(n).alias(n) for n in ("value", "low", "high")])


@query("evaluation_summary", f"""WITH {SCORES}, {_weights('run')}, {_areas('rep', f'({_scaled(True)})', 'g, r')}, {POINT}, {_binomials('run', 0.35)},
p AS (SELECT *, (nn - fp + 0.5 * neg) / nn AS below, (tp - 0.5 * pos) / np AS above FROM point0),
s AS (SELECT g, max(np) AS np, max(nn) AS nn, sum(pos * below) AS x1, sum(pos * below * below) AS x2, sum(neg * above) AS y1, sum(neg * above * above) AS y2 FROM p GROUP BY g),
roc AS (SELECT g, x1 / np AS v, sqrt((x2 - x1 * x1 / np) / (np - 1) / np + (y2 - y1 * y1 / nn) / (nn - 1) / nn) AS se FROM s),
pr AS (SELECT g, round(max(p.aupr), 6) AS "value", {_bounds('max(p.aupr)', 'avg(rep.aupr)', 'stddev_samp(rep.aupr)')} FROM rep JOIN point p USING (g) GROUP BY g),
f AS (SELECT g, round(max(f1v.v), 6) AS "value", {_bounds('max(f1v.v)', 'avg(f1.v)', 'stddev_samp(f1.v)')} FROM f1 JOIN f1v USING (g) GROUP BY g),
e AS (SELECT run AS g, avg(abs(original_value - predicted_value)) AS m, sqrt(avg(pow(original_value - predicted_value, 2))) AS q FROM scores GROUP BY run)
SELECT g AS run, round(roc.v, 6) AS "AUROC value", round(greatest(v - 1.959963984540054 * se, 0), 6) AS "AUROC low", round(least(v + 1.959963984540054 * se, 1), 6) AS "AUROC high",
 pr.value AS "AUPR value", pr.low AS "AUPR low", pr.high AS "AUPR high", f.value AS "F1 value", f.low AS "F1 low", f.high AS "F1 high",
 round(m, 6) AS "MAE (g / L)", round(q, 6) AS "RMSE (g / L)", round(m * 0.06204, 6) AS "MAE (mmol / L)", round(q * 0.06204, 6) AS "RMSE (mmol / L)"
FROM roc JOIN pr USING (g) JOIN f USING (g) JOIN e USING (g)""")
def _(t):
    s = t.scores().withColumnRenamed("id", "row")
    found = metrics.evaluation_summary(s, 0.35, ["run"], label="label", replicates=REPLICATES, values=("original_value", "predicted_value"))
    return found.select("run", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in found.columns if c != "run"])


@query("prediction_table", f"WITH {SCORES} SELECT grp, score, label, predicted FROM scores")
def _(t):
    return metrics.prediction_table(t.scores().select("id", "grp", "score", "label", "predicted"), seed=7)


GRID = [round(0.02 * i, 2) for i in range(1, 50)]
_K = COST_CONSTANTS


def cost_sql(months, tpr, fpr, sex):
    """SQL of q, a and E: shares of the four cells (sex, outcome), each with its chance of the longer interval."""
    d = _K["d"]
    cells = ", ".join(
        f"('{who}', {share!r}::DOUBLE, {months / regular!r}::DOUBLE, {low})"
        for who, regular, r, m in (("male", 2, "mr", "mdr"), ("female", 3, "fr", "fdr"))
        for low, share in ((True, _K[m] * d), (False, _K[r] - _K[m] * d))
    )
    chance = f"CASE WHEN {sex} NOT IN (who, 'both') THEN 0 WHEN low THEN 1 ELSE {fpr} END"
    a = f"(SELECT sum(share) + sum(share * (longer - 1) * ({chance})) FROM (VALUES {cells}) AS cell(who, share, longer, low))"
    q = f"({tpr} * (SELECT sum(share) FILTER ({sex} IN (who, 'both')) FROM (VALUES ('male', {_K['mdr']!r}::DOUBLE), ('female', {_K['fdr']!r}::DOUBLE)) AS part(who, share)))"
    e = f"({_K['Pm']} * ({a} / ({_K['Fn']} * {a} + 1 - {_K['Fn']}) - 1) - {_K['Pd'] * d!r}::DOUBLE * {q})"
    return q, a, e


def _grid_sql():
    q6, a6, e6 = cost_sql(6, "tpr", "fpr", "sex")
    q12, a12, e12 = cost_sql(12, "tpr", "fpr", "sex")
    values = ", ".join(f"({g})" for g in GRID)
    return f"""WITH {SCORES}, g AS (SELECT CAST(probability AS DOUBLE) AS probability FROM (VALUES {values}) AS v(probability)),
r AS (SELECT run, probability, count(*) FILTER (score >= probability AND label = 1) / count(*) FILTER (label = 1) AS tpr, count(*) FILTER (score >= probability AND label = 0) / count(*) FILTER (label = 0) AS fpr,
  CASE WHEN run LIKE '%female%' THEN 'female' ELSE 'male' END AS sex FROM scores, g GROUP BY run, probability),
grid AS (SELECT run, probability, tpr AS TPR_, fpr AS FPR_, {q6} AS q6, {a6} AS a6, {e6} AS E6, {q12} AS q12, {a12} AS a12, {e12} AS E12 FROM r)"""


def cost_grid(t):
    sex = F.get(F.split("run", "-", 3), 1)
    return metrics.cost_by_threshold(t.scores(), GRID, by=["run"], sex=sex)


@query("cost_by_threshold", _grid_sql() + """ SELECT run, probability, round(TPR_, 6) AS "TPR", round(FPR_, 6) AS "FPR", round(q6, 6) AS q6, round(a6, 6) AS a6, round(E6, 6) AS "E6", round(q12, 6) AS q12, round(a12, 6) AS a12, round(E12, 6) AS "E12" FROM grid""")
def _(t):
    g = cost_grid(t)
    return g.select("run", "probability", *[r6(n).alias(n) for n in ("TPR", "FPR", "q6", "a6", "E6", "q12", "a12", "E12")])


@query("optimal_cost_threshold", _grid_sql() + """ SELECT run, arg_min(probability, round(E6, 9)) AS threshold6, arg_min(probability, round(E12, 9)) AS threshold12, round(min(E6), 6) AS "E6", round(min(E12), 6) AS "E12" FROM grid GROUP BY run""")
def _(t):
    o = metrics.optimal_cost_threshold(cost_grid(t), ["run"])
    return o.select("run", "threshold6", "threshold12", r6("E6").alias("E6"), r6("E12").alias("E12"))


def _cost_ci_sql():
    """Both thresholds, the value of each measure and its bounds, from the same weights as the areas."""
    names = metrics.COST_MEASURES
    sex = "CASE WHEN g LIKE '%female%' THEN 'female' ELSE 'male' END"

    def measures(name, rows, keys):
        rates = ", ".join(f"CAST({side}_{n} AS DOUBLE) / {of} AS {rate}{n}" for n in ("6", "12") for side, of, rate in (("tp", "np", "tpr"), ("fp", "nn", "fpr")))
        parts = [cost_sql(m, f"tpr{m}", f"fpr{m}", "sex") for m in (6, 12)]
        costs = ", ".join(f"{x} AS {n}{m}" for m, found in zip((6, 12), parts, strict=True) for n, x in zip("qae", found, strict=True))
        return f"""{name}_r AS (SELECT {keys}, {sex} AS sex, {rates}, 2.0::DOUBLE * tp_1 / (tp_1 + fp_1 + np) AS f1, aupr, auroc FROM {rows}),
{name} AS (SELECT *, {costs} FROM {name}_r)"""

    cuts = (("6", "threshold6"), ("12", "threshold12"), ("1", "0.5"))
    sums = ", ".join(f"sum({c}) FILTER (threshold >= {t}) AS {side}_{n}" for n, t in cuts for side, c in (("tp", "pos"), ("fp", "neg")))
    joined = "{0} JOIN best ON best.run = {0}.g"
    rows = " UNION ALL ".join(
        f"""SELECT g AS "run", '{n}' AS variable, round(max(p.{n}), 6) AS v, round(2 * max(p.{n}) - avg(d.{n}) - 1.959963984540054 * stddev_samp(d.{n}), 6) AS lo,
 round(2 * max(p.{n}) - avg(d.{n}) + 1.959963984540054 * stddev_samp(d.{n}), 6) AS hi FROM d JOIN p USING (g) GROUP BY g""" for n in names)
    return f"""{_grid_sql()}, best AS (SELECT run, arg_min(probability, round(E6, 9)) AS threshold6, arg_min(probability, round(E12, 9)) AS threshold12 FROM grid GROUP BY run),
{_weights('run')}, {_areas('area', f'({_scaled(False)})', 'g, r')}, {POINT},
drep AS (SELECT g, r, {sums}, max(np) AS np, max(nn) AS nn, any_value(aupr) AS aupr, any_value(auroc) AS auroc FROM (SELECT wt.*, aupr, auroc, threshold6, threshold12 FROM wt JOIN area USING (g, r) JOIN best ON best.run = g) GROUP BY g, r),
prep AS (SELECT g, {sums}, sum(pos) AS np, sum(neg) AS nn, any_value(aupr) AS aupr, any_value(auroc) AS auroc FROM (SELECT counted.*, aupr, auroc, threshold6, threshold12 FROM counted JOIN point USING (g) JOIN best ON best.run = g) GROUP BY g),
{measures('d', 'drep', 'g, r')}, {measures('p', 'prep', 'g')},
m AS ({rows})
SELECT run, variable, 'value' AS type, v AS "value" FROM m UNION ALL SELECT run, variable, 'low', lo FROM m UNION ALL SELECT run, variable, 'high', hi FROM m
UNION ALL SELECT run, 'threshold6', 'value', threshold6 FROM best UNION ALL SELECT run, 'threshold12', 'value', threshold12 FROM best"""


@query("cost_with_ci", _cost_ci_sql())
def _(t):
    found = metrics.cost_with_ci(t.scores().withColumnRenamed("id", "row"), "run", GRID, replicates=REPLICATES)
    return found.withColumn("value", r6("value"))
