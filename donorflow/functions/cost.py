"""The economic effect of acting on predictions, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.functions.expr import column
from donorflow.functions.metadata import COST_CONSTANTS


def _num(value: Any) -> Column:
    return column(value) if isinstance(value, (str, Column)) else F.lit(float(value))


def economic_cost(
    q: Any, a: Any, Pm: Any = 2.0, Pd: Any = 60.0, F_: Any = 1.0, Fn: Any = 0.1066,
    rloss: Any = 0.0, d: Any = 0.03269718, form: str = "new",
) -> Column:
    """Cost per donation for avoided deferrals ``q`` and interval extension ``a``.

    ``new`` scales the loss of donors by (1 - Fn), ``old`` does not, ``simplified`` is the
    two-variable form with the fixed constants.
    """
    q, a = _num(q), _num(a)
    if form == "simplified":
        return 2.0 / ((1 - 0.1066) / a + 0.1066) - 2.0 - 60.0 * 0.03269718 * q
    Pm, Pd, F_, Fn, rloss, d = (_num(v) for v in (Pm, Pd, F_, Fn, rloss, d))
    lost = d * q * rloss
    if form == "new":
        lost = (1 - Fn) * lost
    elif form != "old":
        raise ValueError(f"unknown cost form: {form}")
    longer = (F_ * a) / (F_ + Fn * (a - 1)) - 1
    return Pm * (longer - lost) - Pd * d * q


# The shortest regular interval in months, by sex.
REGULAR_MONTHS = {"male": 2.0, "female": 3.0}


def interval_extension(
    tpr: Any, fpr: Any, months: float, sex: Any, p: Mapping[str, float] | None = None
) -> dict[str, Column]:
    """Avoided deferrals q, mean interval factor a and cost E for a new interval.

    A sex with share r of the donations and share m of the deferrals d has r - m d accepted ones. The new interval is f
    times the regular one: deferred donors always get it, accepted ones when they are predicted deferred. Without a model
    for a sex, its donors keep factor 1.
    """
    p = {**COST_CONSTANTS, **(p or {})}
    tpr, fpr = _num(tpr), _num(fpr)
    sex = F.lit(sex) if isinstance(sex, str) and sex in ("male", "female", "both") else column(sex)
    shares = {"male": (p["mr"], p["mdr"]), "female": (p["fr"], p["fdr"])}
    a = F.lit(0.0)
    for who, (r, m) in shares.items():
        f, low = months / REGULAR_MONTHS[who], m * p["d"]
        mean = (r - low) * (1 + (f - 1) * fpr) + f * low
        a = a + F.when(sex.isin(who, "both"), mean).when(sex.isNotNull(), F.lit(r))
    found = F.when(sex == "both", F.lit(1.0))
    for who, (_, m) in shares.items():
        found = found.when(sex == who, F.lit(m))
    q = found * tpr
    return {"q": q, "a": a, "E": economic_cost(q, a, p["Pm"], p["Pd"], 1.0, p["Fn"], p["rloss"], p["d"])}


def cost_columns(df: DataFrame, tpr6: Any, fpr6: Any, tpr12: Any, fpr12: Any, sex: Any,
                 p: Mapping[str, float] | None = None) -> DataFrame:
    """Add q, a and E for new intervals of 6 and 12 months."""
    out = {}
    for months, tpr, fpr in ((6, tpr6, fpr6), (12, tpr12, fpr12)):
        for name, value in interval_extension(tpr, fpr, months, sex, p).items():
            out[f"{name}{months}"] = value
    return df.withColumns(out)


def cost_surface(df: DataFrame, a: str, q: str, form: str = "simplified", rescale: float | None = None) -> DataFrame:
    """Cost at every (a, q) pair of a grid; q can be shown as a share of the prevalence."""
    out = df.withColumn("E", economic_cost(q, a, form=form))
    return out.withColumn(q, F.col(q) / rescale) if rescale else out


def cost_gradient(df: DataFrame, arguments: Mapping[str, Any], step: float = 1e-5) -> DataFrame:
    """Central differences of the new cost form in every argument, one column each."""
    base = {k: _num(v) for k, v in arguments.items()}
    names = {"q": "q", "atot": "a", "Pm": "Pm", "Pd": "Pd", "F": "F_", "Fn": "Fn", "rloss": "rloss", "d": "d"}
    out = {}
    for name in base:
        if name == "d":
            continue
        up = {names[k]: (v + step if k == name else v) for k, v in base.items()}
        down = {names[k]: (v - step if k == name else v) for k, v in base.items()}
        out[f"d_{name}"] = (economic_cost(**up) - economic_cost(**down)) / (2 * step)
    return df.withColumns(out)
