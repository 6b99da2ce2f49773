"""Fixed descriptions of variables, thresholds and cost constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Variable name, display name, type.
DONATION_VARIABLES = [
    ("donor", "Donor ID", "Factor"),
    ("Hb", "Hemoglobin", "numeric"),
    ("days_to_previous_fb", "Days to previous full blood donation", "numeric (int)"),
    ("age", "Age", "numeric"),
    ("previous_Hb_def", "Previous event low hemoglobin", "boolean"),
    ("year", "Year", "numeric (int)"),
    ("warm_season", "Warm season", "boolean"),
    ("consecutive_deferrals", "Consecutive deferrals", "numeric (int)"),
    ("recent_donations", "Recent donations", "numeric (int)"),
    ("recent_deferrals", "Recent low hemoglobins", "numeric (int)"),
    ("hour", "Hour", "numeric"),
    ("previous_Hb", "Previous Hb", "numeric"),
    ("previous_Hb2", "Previous Hb 2", "numeric"),
    ("previous_Hb3", "Previous Hb 3", "numeric"),
    ("previous_Hb4", "Previous Hb 4", "numeric"),
    ("previous_Hb5", "Previous Hb 5", "numeric"),
    ("Hb_first", "First Hb", "numeric"),
    ("Hb_deferral", "Low hemoglobin", "boolean"),
    ("sex", "Sex", "Factor"),
    ("days_to_previous_Hb", "Days to previous Hb", "numeric (int)"),
    ("days_to_previous_Hb2", "Days to previous Hb 2", "numeric (int)"),
    ("days_to_previous_Hb3", "Days to previous Hb 3", "numeric (int)"),
    ("days_to_previous_Hb4", "Days to previous Hb 4", "numeric (int)"),
    ("days_to_previous_Hb5", "Days to previous Hb 5", "numeric (int)"),
]
DONOR_VARIABLES = [
    ("smoking", "Smoking", "boolean"),
    ("height", "Height", "numeric"),
    ("weight", "Weight", "numeric"),
    ("RNF43_mutant", "RNF43", "boolean"),
    ("prs", "Polygenic score", "numeric"),
    ("FERRITIN_FIRST", "First ferritin", "numeric"),
    ("FERRITIN_LAST", "Last ferritin", "numeric"),
    ("one_deferral", "At least one deferral", "numeric (int)"),
    ("label", "Partition label", "factor"),
]
LAB_VARIABLES = [
    ("Eryt", "Erythrocyte", "Numeric"),
    ("HKR", "HCT", "Numeric"),
    ("Leuk", "Leukocyte", "Numeric"),
    ("Trom", "Thrombocyte", "Numeric"),
    ("MCH", "MCH", "Numeric"),
    ("MCHC", "MCHC", "Numeric"),
    ("MCV", "MCV", "Numeric"),
    ("RDW", "RDW", "Numeric"),
    ("CRP", "CRP", "Numeric"),
    ("Ferritin", "Ferritin", "Numeric"),
    ("TransferrinR", "Transferrin receptor", "Numeric"),
]
SURVEY_VARIABLES = [
    ("height", "Height", "Numeric"),
    ("weight", "Weight", "Numeric"),
    ("smoking_status", "Smoking status", "Boolean"),
    ("physical_condition", "Physical condition", "Numeric (int)"),
    ("meat_amount", "Meat amount", "Numeric (int)"),
    ("sleep_quality", "Sleep quality", "Numeric (int)"),
    ("iron_supplement", "Iron supplement", "Numeric (int)"),
]

# Display names that replace the table above in result tables. The first
# name is used for plain variables, the second for dummy-coded ones.
DISPLAY_OVERRIDES = [
    ("previous_Hb_def", "previous_Hb_defTRUE", "Previous donation deferred"),
    ("warm_season", "warm_seasonTRUE", "Warm season"),
    ("smoking", "smokingTRUE", "Smoking"),
    ("RNF43_mutant", "RNF43_mutantTRUE", "RNF43 minor allele"),
    ("sex", "sexfemale", "Sex"),
    ("nb_donat", "nb_donat", "Number of donations"),
]

# Ordered survey answers and their codes.
SURVEY_CODES = {
    "physical_condition": {
        "very_bad": 0, "rather_bad": 1, "satisfactory": 2, "rather_good": 3, "good": 4, "excellent": 5,
    },
    "meat_amount": {
        "never": 0, "less_than_once_weekly": 1, "1.3_week": 2, "4.6_week": 3, "daily": 4, "several_daily": 5,
    },
    "sleep_quality": {"never": 0, "rarely": 1, "mostly": 2, "always_or_almost": 3},
}

# Shares of returning donors and deferrals by sex, deferral prevalence, and
# the unit costs of the economic model.
COST_CONSTANTS = {
    "mr": 0.4732352, "fr": 0.5267648, "mdr": 0.2335795, "fdr": 0.7664205, "d": 0.03269718,
    "Pm": 2.0, "Pd": 60.0, "Fn": 0.1066, "rloss": 0.0,
}

# Seconds in a duration year (365.25 days) and hemoglobin unit factors.
YEAR_SECONDS = 31_557_600
MMOL_PER_GRAM = 0.01551 * 4
UNIT_RANGES = {"gperl": (100.0, 200.0), "gperdl": (10.0, 20.0), "mmolperl": (0.0, 10.0)}

# Shares of train, validate and test donors.
SPLIT_SHARES = (("train", 0.64), ("validate", 0.16), ("test", 0.20))


def variable_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Variable descriptions as a small table, one row per variable."""
    rows = rows if rows is not None else DONATION_VARIABLES + DONOR_VARIABLES
    return spark.createDataFrame(rows, "Variable string, Pretty string, Type string")
