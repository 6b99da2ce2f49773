"""The feature plan against a plain loop over subjects, and its edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from donorflow.plans import features as plan
from donorflow.plans.features import Settings


def make_raw(seed=7, donors=40):
    """Small raw tables with ties, retries, unknown values and all event types."""
    rng = random.Random(seed)
    events, people, number = [], [], 0
    for i in range(donors):
        donor = f"d{i:03d}"
        dob = dt.date(rng.choice([1950, 1964, 1980, 1996]), rng.choice([2, 6]), rng.choice([28, 11]))
        if i == 3:
            dob = dt.date(1996, 2, 29)
        sex = "M" if i % 2 else "F"
        people.append((donor, sex, "bad" if i == 5 else dob.strftime("%Y%m%d"), "20000101"))
        day = dt.date(2012, 1, 1) + dt.timedelta(days=rng.randrange(900))
        for k in range(rng.choice([1, 2, 6, 14]) if i else 60):
            number += 1
            day += dt.timedelta(days=rng.choice([0, 0, 61, 92, 200, 731]))
            hhmm = rng.choice([None, "0", "0905", "1340", "1340"])
            kind = rng.choice(["K", "K", "K", "*", "*", "H"]) if k or i % 9 else "H"
            hb = None if rng.random() < 0.03 else round(rng.uniform(11.0, 17.0), 3)
            date = day.strftime("%Y%m%d")
            if i == 8 and k == 0:
                date = "20131399"
            if i == 9 and k == 0:
                date = dob.strftime("%Y%m%d")
            if i == 10 and k == 0:
                date = "19390101"
            status = rng.choice(["-", "-", "X", None])
            events.append((f"e{number:05d}", donor, date, hhmm, status, kind, rng.choice([450, 500, 90, None]), hb))
    events.append(("e99999", "nobody", "20150101", None, "-", "K", 500, 14.0))
    return events, people


def frames(spark, events, people):
    d = spark.createDataFrame(events, "KEY_DONAT_INDEX_DON string, KEY_DONOR string, KEY_DONAT_INDEX_DATE string, DONAT_PHLEB_START string, DONAT_STATUS string, KEY_DONAT_PHLEB string, DONAT_VOL_DRAWN int, DONAT_RESULT_CODE double")
    p = spark.createDataFrame(people, "KEY_DONOR string, KEY_DONOR_SEX string, KEY_DONOR_DOB string, DONOR_DATE_FIRST_DONATION string")
    return d, p


def parse(date, hhmm):
    try:
        return dt.datetime.strptime(date + (hhmm or "0").rjust(4, "0"), "%Y%m%d%H%M")
    except ValueError:
        return None


def loop(events, people, restrict=False, male=135.0, female=125.0):
    """The rules one after the other, in plain Python."""
    by_donor = {p[0]: p for p in people}
    data = []
    for number, donor, date, hhmm, status, kind, volume, hb in events:
        if donor not in by_donor:
            continue
        _, sex, dob, _ = by_donor[donor]
        born, at = parse(dob, None), parse(date, hhmm)
        hb = None if hb is None else hb * 10.0
        low = hb is not None and hb < (male if sex == "M" else female)
        data.append(dict(id=number, donor=donor, at=at, day=at and at.date(), born=born and born.date(), status=status, kind=kind, volume=volume, hb=hb, low=low, sex=sex))
    log = []

    def apply(keep):
        nonlocal data
        before, donors = len(data), len({r["donor"] for r in data})
        data = [r for r in data if keep(r)]
        log.append((before - len(data), before, donors - len({r["donor"] for r in data}), donors))

    def age(r):
        return r["day"].year - r["born"].year - ((r["day"].month, r["day"].day) < (r["born"].month, r["born"].day))

    apply(lambda r: not (r["day"] and r["born"] and r["day"] == r["born"]))
    apply(lambda r: r["day"] and r["born"])
    apply(lambda r: r["day"] != dt.date(1939, 1, 1))
    apply(lambda r: age(r) >= 18)
    apply(lambda r: r["hb"] is not None)
    last = {}
    for r in data:
        last[r["donor"], r["day"]] = max(r["at"], last.get((r["donor"], r["day"]), r["at"]))
    apply(lambda r: r["at"] == last[r["donor"], r["day"]])
    end = max(r["day"] for r in data)
    seconds = lambda day: (day - dt.date(1970, 1, 1)).days * 86400
    apply(lambda r: not restrict or seconds(r["day"]) >= seconds(end) - 5 * 31557600)
    log.append((0, len(data), 0, len({r["donor"] for r in data})))
    data.sort(key=lambda r: (r["at"], r["id"]))
    first, held = {}, {}
    for r in data:
        first.setdefault(r["donor"], r["day"])
        r["first"] = r["day"] == first[r["donor"]]
        r["days"] = (r["day"] - held[r["donor"]]).days if r["donor"] in held else None
        v, s = r["volume"], r["status"]
        full = (r["kind"] == "K" and s == "-") or (v is not None and v > 100 and ((r["kind"] == "K" and s is not None and s != "-") or r["kind"] == "H"))
        if full:
            held[r["donor"]] = r["day"]
    apply(lambda r: r["kind"] in ("K", "*"))
    kept = {r["donor"] for r in data if r["first"]}
    apply(lambda r: r["donor"] in kept)
    apply(lambda r: r["first"] or r["days"] is not None)
    active = {r["donor"] for r in data if seconds(r["day"]) >= seconds(end) - 31557600}
    apply(lambda r: not restrict or r["donor"] in active)

    hours = [r["at"].hour + r["at"].minute / 60 for r in data]
    mean_hour = sum(h for h in hours if h) / max(1, sum(1 for h in hours if h))
    out, history = [], {}
    for r, h in zip(data, hours):
        past = history.setdefault(r["donor"], [])
        run = 0
        for p in reversed(past):
            if not p["low"]:
                break
            run += 1
        clock = lambda x: (x["at"] - dt.datetime(1970, 1, 1)).total_seconds()
        peers = [p for p in data if p["donor"] == r["donor"]]
        n5 = sum(p["kind"] == "K" for p in peers if clock(r) - 157788000 <= clock(p) <= clock(r)) - (r["kind"] == "K")
        n2 = sum(p["low"] for p in peers if clock(r) - 63115200 <= clock(p) <= clock(r)) - r["low"]
        lag = lambda n: past[-n] if len(past) >= n else None
        out.append((
            r["id"], r["donor"], r["day"], r["first"], r["days"], age(r), r["low"], lag(1)["low"] if lag(1) else None,
            round(lag(1)["hb"], 6) if lag(1) else 0.0, round(lag(5)["hb"], 6) if lag(5) else None,
            (r["day"] - lag(3)["day"]).days if lag(3) else None, run, n5, n2, round((past[0] if past else r)["hb"], 6),
            round(h if h else mean_hour, 6), len(peers), "male" if r["sex"] == "M" else "female",
        ))
        past.append(r)
    return out, log


ROUNDED = {"previous_Hb", "previous_Hb5", "Hb_first", "hour"}
NAMES = [
    "don_id", "donor", "dateonly", "first_event", "days_to_previous_fb", "age", "Hb_deferral", "previous_Hb_def",
    "previous_Hb", "previous_Hb5", "days_to_previous_Hb3", "consecutive_deferrals",
    "recent_donations", "recent_deferrals", "Hb_first", "hour", "nb_donat_progesa", "sex",
]


@pytest.mark.parametrize("restrict,chunk_rows", [(False, None), (True, None), (True, 12)])
def test_features_and_audit_match_a_plain_loop(spark, restrict, chunk_rows):
    raw = make_raw()
    want, log = loop(*raw, restrict=restrict)
    settings = Settings(unit="gperdl", restrict=restrict, chunk_rows=chunk_rows)
    d, p = frames(spark, *raw)
    got = plan.whole_series_features(d, p, settings)
    columns = [F.round(c, 6) if c in ROUNDED else F.col(c) for c in NAMES]
    assert rows(got, *columns) == sorted(want, key=repr)
    table = plan.audit(d, p, settings).orderBy("step").select("rows_dropped", "rows_before", "donors_dropped", "donors_before")
    assert [tuple(r) for r in table.collect()] == log


def test_order_and_partitions_do_not_matter(spark):
    d, p = frames(spark, *make_raw(11, 20))
    s = Settings(unit="gperdl")
    a = plan.whole_series_features(d, p, s)
    b = plan.whole_series_features(d.orderBy(F.rand(3)).repartition(5), p.repartition(2), s)
    assert rows(a) == rows(b)


def test_duplicate_subjects_are_an_error(spark):
    events, people = make_raw(3, 5)
    d, p = frames(spark, events, people + people[:1])
    with pytest.raises(ValueError, match="duplicate"):
        plan.whole_series_features(d, p)


def test_one_exchange_on_the_subject(spark, tables):
    settings = Settings()
    hot = plan.HotKeys()
    events = tables.joined()
    tagged = plan.tag_exclusions(events, settings, hot)
    text = plan.derive_features(tagged.withColumn("nb_donat_progesa", F.col("nb_donat_progesa")), settings, hot)._jdf.queryExecution().executedPlan().toString()
    main = text.split("Subquery")[0]
    assert main.count("Exchange hashpartitioning(donor") <= 2  # the join side and the windows
