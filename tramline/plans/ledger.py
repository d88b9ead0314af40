"""The ledger of findings: one schema, union, counts, decision, order and cap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.contract import FINDINGS_CAP, SEVERITIES

FINDING = ["rule_id", "severity", "category", "file", "row", "key", "observed", "expected", "context"]
COLUMNS = ["feed", *FINDING]


def _text(v: Column | str | None) -> Column:
    return (F.lit(v) if v is None or isinstance(v, str) else v).cast("string")


def finding(rule: str, severity: str | Column, category: str, file: str, row: Column | None = None, key: Column | str | None = None, observed: Column | str | None = None, expected: Column | str | None = None, context: dict[str, Column] | None = None) -> list[Column]:
    """The columns of FINDING; context is what else tells the finding, as JSON with its keys in order."""
    values = {"rule_id": _text(rule), "severity": _text(severity), "category": _text(category), "file": _text(file), "row": (F.lit(None) if row is None else row).cast("bigint"), "key": _text(key), "observed": _text(observed), "expected": _text(expected), "context": F.to_json(F.struct(*[c.alias(n) for n, c in sorted(context.items())])) if context else _text(None)}
    return [v.alias(n) for n, v in values.items()]


def as_findings(rows: DataFrame, *parts: Column) -> DataFrame:
    return rows.select(F.col("_feed").alias("feed"), *parts)


def row_checks(rows: DataFrame, checks: list[tuple[Column, list[Column]]]) -> DataFrame:
    """All findings of rules that look at one row only, in one scan; checks: (holds, finding(...)) pairs."""
    if not checks:
        return rows.where("false").select(F.col("_feed").alias("feed"), *finding("", "", "", ""))
    every = F.array(*[F.when(holds, F.struct(*parts)) for holds, parts in checks])
    return rows.select(F.col("_feed").alias("feed"), F.inline(F.filter(every, lambda x: x.isNotNull())))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(rank(F.col("severity")), "rule_id", "file", F.col("row").asc_nulls_first(), "key", "feed")


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("feed", "severity").agg(F.count("*").alias("n"))


def decision(findings: DataFrame) -> DataFrame:
    """(feed, decision, blockers, errors, warnings, infos)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    per = findings.groupBy("feed").agg(n("blocker").alias("blockers"), n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    return per.withColumn("decision", F.when(F.col("blockers") > 0, "BLOCKED").when(F.col("errors") + F.col("warnings") > 0, "NEEDS REVIEW").otherwise("ELIGIBLE FOR APPROVAL"))


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def samples(findings: DataFrame, by: list[str], k: int, buckets: int = 64) -> DataFrame:
    """The first k rows per group with the group's exact total; the ranking runs in buckets first, so no group meets in one task whole."""
    order = [F.col("row").asc_nulls_last(), "key", "observed"]
    near = findings.withColumn("_b", F.pmod(F.xxhash64("row", "key", "observed"), F.lit(buckets)))
    inside = W.partitionBy(*by, "_b")
    near = near.withColumn("_i", F.row_number().over(inside.orderBy(*order))).withColumn("_n", F.count("*").over(inside)).where(F.col("_i") <= k)
    # The first row of a bucket brings the bucket's number; the buckets' sum is the group's.
    whole = W.partitionBy(*by)
    top = near.withColumn("total", F.sum(F.when(F.col("_i") == 1, F.col("_n"))).over(whole)).withColumn("place", F.row_number().over(whole.orderBy(*order))).where(F.col("place") <= k)
    return top.drop("_b", "_i", "_n")


def capped(findings: DataFrame, cap: int = FINDINGS_CAP) -> tuple[DataFrame, int]:
    """The ledger's first `cap` findings in its order, and how many it leaves out; the cap is the feature."""
    return ordered(findings).limit(cap), max(0, findings.count() - cap)
