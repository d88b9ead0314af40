"""Rules of an agency's profile, with the agency's own lists and exceptions as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.functions.scalars import row_label
from tramline.plans.ledger import finding, row_checks

#: Formats of text fields.
FORMATS = {
    "url": r"^https?://",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "phone": r"^[0-9+\-().\s]+$",
    "language": r"^[a-zA-Z]{2,3}(-[a-zA-Z]{2})?$",
    "digits": r"^[0-9]+$",
    "colour": r"^[0-9A-Fa-f]{6}$",
}


def missing_values(rows: DataFrame, table: str, columns: list[str], ident: str, allowed: dict[str, list[str]] | None = None, severity: str = "error") -> DataFrame:
    """AG04, AG13, AG19: blank values of the columns, except on the ids that a column allows."""
    key = row_label(strip(ident), F.col("_row"))
    checks = [((strip(c) == "") & ~strip(ident).isin((allowed or {}).get(c, [])) if (allowed or {}).get(c) else strip(c) == "", finding("AG04", severity, "Agency", table, F.col("_row"), key, c)) for c in columns]
    return row_checks(rows, checks)


def formats(rows: DataFrame, table: str, columns: dict[str, str], ident: str) -> DataFrame:
    """AG07: non-blank values that don't have the format named for the column."""
    key = row_label(strip(ident), F.col("_row"))
    return row_checks(rows, [((strip(c) != "") & ~strip(c).rlike(FORMATS[f]), finding("AG07", "error", "Agency", table, F.col("_row"), key, F.concat(F.lit(f"{c}: "), strip(c)), f)) for c, f in columns.items()])


def expected_empty(rows: DataFrame, table: str, columns: list[str], ident: str, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """AG17, AG20: values where none is expected, but for the allowed ones."""
    key = row_label(strip(ident), F.col("_row"))
    ok = lambda c: strip(c).isin(["", *(allowed or {}).get(c, [])])
    return row_checks(rows, [(~ok(c), finding("AG17", "warning", "Agency", table, F.col("_row"), key, F.concat(F.lit(f"{c}: "), strip(c)))) for c in columns if c in rows.columns])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """AG21: (feed, value, n)."""
    return rows.groupBy(F.col("_feed").alias("feed"), strip(column).alias("value")).agg(F.count("*").alias("n"))


def parent_summary(stops: DataFrame) -> DataFrame:
    """AG23: (feed, parent, children, known): children per parent station and whether the parent is there."""
    kids = stops.select("_feed", strip("stop_id").alias("k"), strip("parent_station").alias("parent")).where("parent != ''").groupBy("_feed", "parent").agg(F.count_distinct("k").alias("children"))
    held = stops.select("_feed", strip("stop_id").alias("parent")).distinct().withColumn("known", F.lit(True))
    return kids.join(held, ["_feed", "parent"], "left").select(F.col("_feed").alias("feed"), "parent", "children", F.coalesce("known", F.lit(False)).alias("known"))


def sort_order(routes: DataFrame, reference: DataFrame, order: str = "route_sort_order") -> DataFrame:
    """AG15: (route_short_name, problem): the routes' sort order against a small reference (route_short_name, route_sort_order)."""
    mine = routes.groupBy(strip("route_short_name").alias("name")).agg(F.collect_set(F.nullif(strip(order), F.lit(""))).alias("has"))
    want = reference.select(strip("route_short_name").alias("name"), strip("route_sort_order").alias("want")).where("name != ''").groupBy("name").agg(F.min("want").alias("want"), F.count_distinct("want").alias("n"))
    both = mine.where("name != ''").join(want, "name", "full")
    problem: Column = (
        F.when(F.col("n") > 1, "reference_repeats").when(F.col("want").isNull(), "not_in_reference").when(F.col("has").isNull(), "not_used")
        .when(F.size("has") == 0, "no_value").when(F.size("has") > 1, "several_values").when(~F.col("has")[0].rlike("^[0-9]+$"), "not_a_number").when(F.col("has")[0] != F.col("want"), "differs")
    )
    return both.select(F.col("name").alias("route_short_name"), problem.alias("problem")).where("problem is not null")


def status(findings: DataFrame) -> DataFrame:
    """AG25: (feed, file, status) PASS WITH WARNINGS or FAIL of files with findings; a file without any passes."""
    worst = F.max(F.when(F.col("severity").isin("blocker", "error"), 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return findings.groupBy("feed", "file").agg(worst.alias("w")).select("feed", "file", F.when(F.col("w") == 2, "FAIL").when(F.col("w") == 1, "PASS WITH WARNINGS").otherwise("PASS").alias("status"))
