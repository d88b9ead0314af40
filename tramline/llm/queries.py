"""Queries of the training-data operators on texts and entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.common import table
from tramline.llm import entities, leakage, mixing, mojibake, subjects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def _texts(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "error_warning").select(F.lit("error_warning").alias("tab"), F.col("log_id").alias("src"), F.col("row_id").cast("bigint").alias("row_id"), F.col("message").alias("text"))
    return log.unionByName(table(spark, d, "stops").select(F.lit("stops").alias("tab"), F.col("feed").alias("src"), F.col("row_id").cast("bigint").alias("row_id"), F.col("stop_name").alias("text")))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_rows(_texts(spark, d)).select("tab", "row_id")


@query("p7_repaired")
def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return mojibake.restored_lossy(texts.select("tab", "row_id", "text"), mojibake.garbled_rows(texts))


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leakage.leak_report(leakage.leaked_items(docs, items), docs, items)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(*(table(spark, d, t) for t in ("documents", "subject_labels", "subjects")))


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


@query("p10_composition")
def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    tables = [table(spark, d, t) for t in ("trips", "routes", "calendar", "stop_times")]
    found = entities.matched_runs(entities.runs(*tables, "final"), entities.runs(*tables, "rail"))
    return found.select(F.col("l").alias("final_trip_id"), F.col("r").alias("rail_trip_id"), "confidence")


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("final_trip_id", "rail_trip_id")


@query("p6_pairs")
def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).withColumn("confidence", F.round("confidence", 6))


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_targets")).drop("p")


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_shares(mixing.mixed_documents(table(spark, d, "documents"), targets), targets)
