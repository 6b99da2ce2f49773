"""Files in both formats, checks, sinks and tables of descriptions."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from donorflow.functions import expr
from donorflow.functions.metadata import DONATION_VARIABLES, variable_table
from donorflow.operators import describe, joins, shape
from donorflow.plans.features import Settings, whole_series_features
from donorflow.sources import checks, delimited
from test_features import make_raw, frames


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_named_files_to_features(spark, tmp_path):
    events, people = make_raw(5, 12)
    d, p = frames(spark, events, people)
    names = list(delimited.NAMED_DONATIONS)
    text = lambda v: "" if v is None else str(v)
    position = {n: i for i, n in enumerate(["KEY_DONAT_INDEX_DON", "KEY_DONOR", "KEY_DONAT_INDEX_DATE", "DONAT_PHLEB_START", "DONAT_STATUS", "KEY_DONAT_PHLEB", "DONAT_VOL_DRAWN", "DONAT_RESULT_CODE"])}
    lines = ["|".join(names)] + ["|".join(text(e[position[n]]) for n in names) for e in events]
    people_lines = ["KEY_DONOR|KEY_DONOR_SEX|KEY_DONOR_DOB|DONOR_DATE_FIRST_DONATION|EXTRA"] + ["|".join([*q, "1.5"]) for q in people]
    donations = delimited.scan_donations_named(spark, write(tmp_path, "donations", lines))
    donors = delimited.scan_donors_named(spark, write(tmp_path, "donors", people_lines), ("EXTRA",))
    assert dict(donors.dtypes)["EXTRA"] == "double" and donations.count() == len(events)
    got = whole_series_features(donations, donors, Settings(unit="gperdl"))
    want = whole_series_features(d, p, Settings(unit="gperdl"))
    assert got.count() == want.count()
    assert rows(got.groupBy("donor").count()) == rows(want.groupBy("donor").count())


def test_missing_column_is_named(spark, tmp_path):
    path = write(tmp_path, "bad", ["KEY_DONOR|DONAT_STATUS", "1|-"])
    with pytest.raises(ValueError, match="KEY_DONAT_INDEX_DATE"):
        delimited.scan_donations_named(spark, path)


def test_positional_files(spark, tmp_path):
    line = "|".join(["Y1", "d1", "x", "20150704", "0915", "-", "K", "x", "x", "500", "7", "oops"])
    one = delimited.scan_donations_positional(spark, write(tmp_path, "don", [line])).first()
    assert one["KEY_DONOR"] == "d1" and one["DONAT_VOL_DRAWN"] == 500 and one["DONAT_RESULT_CODE"] is None
    people = ["|".join(["d1", "a", "b", s, *["1"] * 22]) for s in ("Man", "Woman", "?")]
    got = delimited.scan_donors_positional(spark, write(tmp_path, "dn", people))
    assert [r[0] for r in got.select("KEY_DONOR_SEX").collect()] == ["M", "F", None]


def test_unknown_units_are_an_error(spark):
    with pytest.raises(ValueError):
        expr.convert_hb_unit(F.lit(1.0), "gperl", "stone")
    with pytest.raises(ValueError):
        checks.unit_sanity(spark.range(1), "stone")


@pytest.mark.parametrize("dob,at,age", [("2000-02-29", "2018-02-28", 17), ("2000-02-29", "2018-03-01", 18), ("1990-05-05", "2020-05-05", 30)])
def test_age(spark, dob, at, age):
    r = spark.range(1).select(expr.age_at_event(F.lit(dob).cast("date"), F.lit(at).cast("date"))).first()
    assert r[0] == age


def test_null_contract(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    with pytest.raises(ValueError, match="b"):
        checks.require_no_nulls(df)
    assert checks.require_no_nulls(df, ["b"]) is df


def test_results_leave_without_ids(spark, tmp_path):
    a = spark.createDataFrame([("d1", 0.5)], "donor string, score double")
    paths = delimited.result_sink({"prediction": {"rf-male": a, "rf-female": a}}, str(tmp_path))
    back = spark.read.csv(paths["prediction"], header=True)
    assert sorted(back.columns) == ["Id", "score"] and back.count() == 2


def test_small_counts_are_suppressed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 10 + [100] * 4 + [50] * 5], "x double")
    out = {r.bin: r.n for r in describe.suppressed_histogram(df, ["x"]).collect()}
    assert out == {1: 10, 15: 5, 30: 0}


def test_frame_tools(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "id int, v string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "z", 5), (3, "q", 1)], "id int, v string, n int")
    assert rows(joins.frame_diff(a, b, "id")) == [(1, False, False), (2, True, False)]
    assert joins.frame_merge_common(a, b, "id").columns == ["id", "v.x", "v.y", "n"]
    assert rows(shape.row_difference(b, a), "id") == [(2,), (3,)]


def test_descriptions(spark):
    table = variable_table(spark)
    assert table.filter("Variable = 'hour'").first().Pretty == "Hour"
    assert len({v for v, *_ in DONATION_VARIABLES}) == len(DONATION_VARIABLES)


def test_malformed_lines_are_counted(spark, tmp_path):
    header = "|".join(delimited.NAMED_DONATIONS)
    path = write(tmp_path, "lines", [header, "d1|20150704|0915|-|K|500|14.5", "d2|20150704|0915|-|K|many|14.5"])
    scanned = delimited.scan_donations_named(spark, path, corrupt=True)
    assert tuple(delimited.malformed_rows(scanned).first()) == (2, 1)
    assert scanned.filter("KEY_DONOR = 'd2'").first()["DONAT_VOL_DRAWN"] is None


def test_swapped_header_is_an_error(spark, tmp_path):
    """A folder whose second file has its first two columns exchanged must not mix up their values."""
    names = list(delimited.NAMED_DONATIONS)
    folder = tmp_path / "both"
    folder.mkdir()
    (folder / "a").write_text("|".join(names) + "\n" + "|".join(["1"] * len(names)) + "\n")
    (folder / "b").write_text("|".join([names[1], names[0], *names[2:]]) + "\n" + "|".join(["2"] * len(names)) + "\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        delimited.scan_donations_named(spark, str(folder)).collect()


def test_unidentified_predictions_are_refused(spark):
    from donorflow.operators import metrics

    with pytest.raises(ValueError, match="identify"):
        metrics.prediction_table(spark.createDataFrame([(0.5, 1)], "score double, label int"))
