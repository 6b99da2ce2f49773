"""Readers and writers for pipe-delimited donation and donor files, and results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorflow.session import reliable_checkpoint, side_by_side

# Column names of the two file formats, by position.
POSITIONAL_DONATIONS = [
    "KEY_DONAT_INDEX_DON", "KEY_DONOR", "KEY_DONAT_COLLECT", "KEY_DONAT_INDEX_DATE", "DONAT_PHLEB_START",
    "DONAT_STATUS", "KEY_DONAT_PHLEB", "DONAT_DIRECTED", "Field name?", "DONAT_VOL_DRAWN",
    "KEY_DONAT_INDEX_TEST", "DONAT_RESULT_CODE",
]
POSITIONAL_DONORS = [
    "KEY_DONOR", "DONOR_FIRST", "DONOR_NAME", "KEY_DONOR_SEX", "KEY_DONOR_DOB", "DONOR_LANGUAGE",
    "KEY_DONOR_ABORH", "DONOR_ADDR_1_A", "KEY_DONOR_ZIP_1", "DONOR_CITY_1", "DONOR_TEL_1", "DONOR_E_MAIL",
    "DONOR_TEL_MOBILE", "DONOR_NOTIFIABLE", "DONOR_NOTIFICATION_METHOD_1", "DONOR_NOTIFICATION_METHOD_2",
    "DONOR_NOTIFICATION_METHOD_3", "DONOR_NB_DONATIONS", "DONOR_NB_DONAT_PROGESA", "DONOR_NB_DONAT_OUTSIDE",
    "DONOR_DATE_FIRST_DONATION", "DONOR_NB_WB", "DONOR_NB_PLA", "DONOR_NB_THR", "DONOR_LAST_DONAT_PHLEB",
    "DONOR_LAST_COLLECT",
]
NAMED_DONATIONS = {
    "KEY_DONOR": "string", "KEY_DONAT_INDEX_DATE": "string", "DONAT_PHLEB_START": "string",
    "DONAT_STATUS": "string", "KEY_DONAT_PHLEB": "string", "DONAT_VOL_DRAWN": "int", "DONAT_RESULT_CODE": "double",
}
NAMED_DONORS = {
    "KEY_DONOR": "string", "KEY_DONOR_SEX": "string", "KEY_DONOR_DOB": "string",
    "DONOR_DATE_FIRST_DONATION": "string",
}
OPTIONAL_DONORS = {
    "DONOR_NB_DONAT_PROGESA": "int", "DONOR_NB_DONAT_OUTSIDE": "int", "FERRITIN_FIRST": "double",
    "FERRITIN_LAST": "double", "FERRITIN_LAST_DATE": "string", "label": "string",
}

_DONATION_TYPES = {"DONAT_VOL_DRAWN": "double", "DONAT_RESULT_CODE": "double"}
_DONOR_TYPES = {"DONOR_NB_DONATIONS": "int", "DONOR_NB_DONAT_PROGESA": "int", "DONOR_NB_DONAT_OUTSIDE": "int"}


def _ddl(columns: Mapping[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


CORRUPT = "_corrupt_record"


def scan_donations_positional(spark: SparkSession, path: str, corrupt: bool = False) -> DataFrame:
    """Header-less file of 12 columns named by position; values that do not parse are NULL.

    With ``corrupt`` the text of a line that did not fit is kept in ``_corrupt_record``.
    """
    types = {n: _DONATION_TYPES.get(n, "string") for n in POSITIONAL_DONATIONS} | ({CORRUPT: "string"} if corrupt else {})
    return spark.read.schema(_ddl(types)).csv(path, sep="|", mode="PERMISSIVE")


def malformed_rows(scanned: DataFrame) -> DataFrame:
    """Number of lines, and of lines that did not fit the schema, of a scan with ``corrupt``.

    Lines are judged by the columns a query reads, so the scan is held with all of them.
    """
    scanned = reliable_checkpoint(scanned)
    bad = F.sum(F.col(CORRUPT).isNotNull().cast("long"))
    return scanned.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(bad, F.lit(0)).alias("malformed"))


def scan_donors_positional(spark: SparkSession, path: str) -> DataFrame:
    """Header-less file of 26 columns; sex Man / Woman becomes M / F, anything else NULL."""
    types = {n: _DONOR_TYPES.get(n, "string") for n in POSITIONAL_DONORS}
    raw = spark.read.schema(_ddl(types)).csv(path, sep="|", mode="PERMISSIVE")
    sex = F.when(F.col("KEY_DONOR_SEX") == "Man", "M").when(F.col("KEY_DONOR_SEX") == "Woman", "F")
    return raw.withColumn("KEY_DONOR_SEX", sex)


def _header(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).limit(1).collect()
    return line[0][0].split("|") if line else []


def _scan_named(
    spark: SparkSession, path: str, required: Mapping[str, str], optional: Mapping[str, str], corrupt: bool = False
) -> DataFrame:
    names = _header(spark, path)
    missing = [n for n in required if n not in names]
    if missing:
        raise ValueError(f"missing columns in {path}: {', '.join(missing)}")
    known = {**required, **optional}
    types = {n: known.get(n, "string") for n in names} | ({CORRUPT: "string"} if corrupt else {})
    # without enforceSchema, a file of the folder whose header has another order or name is an error, never a swapped column
    return spark.read.schema(_ddl(types)).csv(path, sep="|", header=True, mode="PERMISSIVE", enforceSchema=False)


def scan_donations_named(spark: SparkSession, path: str, corrupt: bool = False) -> DataFrame:
    """File with a header; the seven required columns are typed, extra ones stay text."""
    return _scan_named(spark, path, NAMED_DONATIONS, {}, corrupt)


def scan_donors_named(spark: SparkSession, path: str, extra_numeric: tuple[str, ...] = ()) -> DataFrame:
    """File with a header; optional donor columns keep their types, the rest stay text."""
    optional = {**OPTIONAL_DONORS, **{n: "double" for n in extra_numeric}}
    return _scan_named(spark, path, NAMED_DONORS, optional)


def write_delimited(df: DataFrame, path: str) -> None:
    """Pipe-delimited text with a header, one file per partition."""
    df.write.mode("overwrite").csv(path, sep="|", header=True)


def save_preprocessed(df: DataFrame, path: str) -> None:
    """Feature table as Parquet, one folder per sex."""
    df.write.mode("overwrite").partitionBy("sex").parquet(path)


def load_preprocessed(spark: SparkSession, path: str, sex: str | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame if sex is None else frame.filter(F.col("sex") == sex)


MANIFEST = "manifest"


def result_sink(tables: Mapping[str, Mapping[str, DataFrame]], folder: str) -> dict[str, str]:
    """Write each kind of result as one CSV table: {kind: {Id: frame}} -> {kind: path}.

    Frames of one kind may differ in columns; a kind without frames is left out. Columns that
    identify a subject never leave. A manifest of all kinds is written last, so that readers
    see either a whole run or none.
    """
    from donorflow.operators.shape import union_results

    unions = {kind: union_results(frames) for kind, frames in tables.items() if frames}
    paths = {kind: f"{folder}/{kind}" for kind in unions}

    def write(kind: str) -> None:
        kept = [f"`{c}`" for c in unions[kind].columns if c not in ("donor", "don_id", "id")]
        unions[kind].select(*kept).write.mode("overwrite").csv(paths[kind], header=True)

    if unions:
        spark = next(iter(unions.values())).sparkSession
        side_by_side(spark, write, unions)
        spark.createDataFrame(sorted(paths.items()), "kind string, path string").write.mode("overwrite").csv(f"{folder}/{MANIFEST}", header=True)
    return paths


def load_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a finished run by kind; a folder without manifest is an error."""
    listed = spark.read.csv(f"{folder}/{MANIFEST}", header=True).collect()  # one row a kind
    return {r["kind"]: spark.read.csv(r["path"], header=True) for r in listed}
