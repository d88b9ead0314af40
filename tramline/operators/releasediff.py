"""Keyed, field-level difference of two releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.contract import DIFF_KEYS, NUMERIC
from tramline.operators.copydiff import exact_decimal


def _put(c: str) -> Column:
    return exact_decimal(strip(c)) if c in NUMERIC else strip(c)


def keyed_diff(candidate: DataFrame, reference: DataFrame, table: str, fields: list[str], strict: bool = False) -> DataFrame:
    """(key, status, changed): added, removed or changed keys, with the fields that changed; equal rows give none.

    Numbers are compared by value.  strict stops at a key that a side has twice; else its first row counts.
    """
    keys = DIFF_KEYS[table]

    def side(df: DataFrame, name: str) -> DataFrame:
        key = F.concat_ws(" ¦ ", *[_put(k) if k != "_row" else F.col("_row").cast("string") for k in keys])
        per = df.groupBy(key.alias("key")).agg(F.min(F.struct("_row", F.array(*[_put(f) for f in fields]).alias("v"))).alias("m"), F.count("*").alias("n"))
        if strict and not per.where("n > 1").isEmpty():
            raise ValueError(f"{name} repeats keys of {table}")
        return per.select("key", F.col("m.v").alias(name))

    both = side(candidate, "a").join(side(reference, "b"), "key", "full")
    names = F.array(*map(F.lit, fields))
    changed = F.filter(F.transform(names, lambda f, i: F.when(F.col("a")[i] != F.col("b")[i], f)), lambda f: f.isNotNull())
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return both.select("key", status.alias("status"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), changed).otherwise(F.array().cast("array<string>")).alias("changed")).where("status != 'changed' or size(changed) > 0")


def change_histogram(diff: DataFrame) -> DataFrame:
    """(status, field, n): rows per status, field '' for those, and changes per field."""
    return diff.select("status", F.explode(F.when(F.size("changed") > 0, F.concat(F.array(F.lit("")), "changed")).otherwise(F.array(F.lit("")))).alias("field")).groupBy("status", "field").agg(F.count("*").alias("n"))


def releases_equal(diffs: dict[str, DataFrame]) -> bool:
    return all(d.isEmpty() for d in diffs.values())
