"""Helpers shared by the operators: reading, trimming, cutting lineage, size-checked broadcasts, hot keys."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as Unicode has it; Spark's trim alone knows only the space.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: A side is broadcast only after it was measured to be below this.
BROADCAST_BYTES = 32 << 20

#: Signed number with optional decimals, the only spelling of a coordinate that counts as one.
PLAIN_DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c: Column | str) -> Column:
    """The value without blanks at both ends; null becomes ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(BLANKS))


def ntz(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, so that lost executors cost no recomputation.

    The folder is the session's spark.checkpoint.dir.  Where none is set, a local master gets a private one, as in tests;
    on a cluster a folder of one machine would not do, so there it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="tramline-checkpoint-"))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if its counted rows fit, and whether they did. df should be cheap to count (see cut)."""
    fits = df.count() * row_bytes <= limit
    return (F.broadcast(df) if fits else df), fits


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, share: float = 0.001) -> DataFrame:
    """Keys that hold more than `share` of all rows: fewer than 1/share of them, which bounds any broadcast of it.

    counts: one row per key with its number of rows in n.
    """
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col(n) > F.greatest(F.lit(1000.0), F.col("_total") * share)).select(*keys, n, "_total")


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame, n: str, how: str = "inner", slice_rows: int = 200_000) -> DataFrame:
    """Joins left with right, which has few rows per key, with left's hot keys spread over as many salts as they have slices.

    hot: from hot_keys(), few rows. right's rows of a hot key are repeated once per salt. A row's salt follows from its values,
    so that a stage that is run again after a loss gives the same.
    """
    salts = F.broadcast(hot.select(*keys, F.greatest(F.lit(1), F.ceil(F.col(n) / slice_rows)).cast("int").alias("_salts")))
    rows = left.join(salts, list(keys), "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int"))).drop("_salts")
    spread = right.join(salts, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return rows.join(spread, [*keys, "_salt"], how).drop("_salt")
