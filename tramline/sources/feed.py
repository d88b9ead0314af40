"""Feeds as archives or folders of CSV tables, into DataFrames of text with _feed, _row and what is wrong with their form."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.common import cut, strip
from tramline.contract import CALENDARS, EXPECTED_MEMBERS, KEYS, MAX_MEMBER_BYTES, MAX_RATIO, MAX_TOTAL_BYTES, RATIO_FROM_BYTES, REQUIRED, REQUIRED_MEMBERS
from tramline.plans.ledger import as_findings, finding, row_checks, union

UNSAFE = r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\\|/"


def unsafe_name(name: str) -> bool:
    """Whether a member lies anywhere but at the archive's root."""
    return bool(re.search(UNSAFE, name)) or not name


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def plain_path(text: str | None) -> str:
    """A path without the blanks and quotes that copying put around it."""
    out = (text or "").strip()
    while len(out) >= 2 and (out[0], out[-1]) in {('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’")}:
        out = out[1:-1].strip()
    return out


def members(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """One row per archive member: name, bytes, packed, mode, encrypted, regular, broken; a file that is no archive gives one row without a name."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    out.append((None, 0, 0, 0, False, False, True))
                    continue
                for i in z.infolist():
                    mode = i.external_attr >> 16
                    try:
                        with z.open(i) as f:
                            while f.read(1 << 20):
                                pass
                        bad = False
                    except (zipfile.BadZipFile, RuntimeError, OSError):
                        bad = True
                    out.append((i.filename, i.file_size, i.compress_size, mode, bool(i.flag_bits & 1), (mode & 0o170000) in (0, 0o100000), bad))
            yield pd.DataFrame(out, columns=["name", "bytes", "packed", "mode", "encrypted", "regular", "broken"])

    got = spark.read.format("binaryFile").load(path).select("content").mapInPandas(look, "name string, bytes long, packed long, mode int, encrypted boolean, regular boolean, broken boolean")
    return got.withColumn("_feed", F.lit(feed)).withColumn("_row", F.lit(None).cast("bigint"))


def package_findings(spark: SparkSession, inside: DataFrame) -> DataFrame:
    """PKG001 to PKG018 but for those of a system unpacker, from members(). A bundle's file list is small by its nature."""
    n, mode = F.col("name"), F.col("mode").bitwiseAND(0o777)
    perm = F.lpad(F.conv(mode.cast("string"), 10, 8), 3, "0")
    f = lambda rule, sev, key=None, obs=None, exp=None: finding(rule, sev, "Packaging", "", None, n if key is None else key, obs, exp)
    per = row_checks(inside, [
        (n.isNull(), f("PKG001", "blocker")), (n.rlike(UNSAFE) & ~n.endswith("/"), f("PKG003", "blocker", None, n, "a file at the root")), (n.endswith("/"), f("PKG004", "error")), (F.col("encrypted"), f("PKG005", "blocker")),
        (F.col("bytes") > MAX_MEMBER_BYTES, f("PKG006", "blocker")), ((F.col("bytes") > RATIO_FROM_BYTES) & (F.col("bytes") > MAX_RATIO * F.col("packed")), f("PKG007", "blocker")), (~F.col("regular") & n.isNotNull(), f("PKG008", "blocker")),
        ((F.col("mode") > 0) & (mode.bitwiseAND(0o444) != 0o444), f("PKG009", "blocker", None, perm, "readable by all")), (F.col("broken") & n.isNotNull(), f("PKG011", "blocker")), (n.isNotNull() & ~n.endswith(".txt"), f("PKG017", "warning")),
    ])
    twice = as_findings(inside.groupBy("_feed", "name").agg(F.count("*").alias("n")).where("n > 1"), *f("PKG002", "blocker"))
    total = as_findings(inside.groupBy("_feed").agg(F.sum("bytes").alias("b")).where(F.col("b") > MAX_TOTAL_BYTES), *finding("PKG010", "blocker", "Packaging", ""))
    bare = as_findings(inside.where("mode = 0 and name is not null").groupBy("_feed").agg(F.count("*").alias("n")), *finding("PKG018", "info", "Packaging", "", None, None, F.col("n").cast("string")))
    wanted = spark.createDataFrame([("PKG012", "blocker", f"{m}.txt") for m in REQUIRED_MEMBERS] + [("PKG014", "error", f"{m}.txt") for m in EXPECTED_MEMBERS], "rule string, sev string, name string")
    feeds = inside.select("_feed").distinct()
    lost = feeds.crossJoin(F.broadcast(wanted)).join(inside.select("_feed", "name"), ["_feed", "name"], "left_anti")
    lost = lost.select(F.col("_feed").alias("feed"), *finding("", F.col("sev"), "Packaging", "", None, F.col("name"))[1:], F.col("rule").alias("rule_id"))
    dated = inside.where(F.col("name").isin([f"{c}.txt" for c in CALENDARS])).select("_feed").distinct()
    no_days = as_findings(feeds.join(dated, "_feed", "left_anti"), *finding("PKG013", "blocker", "Packaging", ""))
    return union([per, twice, total, bare, lost, no_days])


def records(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """(_feed, file, table, _row, header, cells, width, bad): every record of every .txt member; _row counts the header as 1.

    A table's header comes as a row of its own, _row 1; file tells which file or archive, and which of its members of that
    name, a record is of.  Cells are put to the header's width; width is what the record had, bad names what stopped the
    reading of a member: encoding, csv, or empty for one without any record.  path may name several archives or CSV files.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows_of(name: str, raw: io.BufferedIOBase) -> Iterator[tuple]:
            n, header = 0, []
            try:
                for values in csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")):
                    n += 1
                    if n == 1:
                        header = [h.strip() for h in values]
                        yield (name, n, header, header, len(values), None)
                    else:
                        yield (name, n, None, (values + [""] * len(header))[: len(header)], len(values), None)
                if not n:
                    yield (name, 1, None, [], 0, "empty")
            except (UnicodeDecodeError, csv.Error) as e:
                yield (name, n + 1, None, [], 0, "encoding" if isinstance(e, UnicodeDecodeError) else "csv")

        def all_rows(path: str, content: bytes) -> Iterator[tuple]:
            if path.endswith(".zip"):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    return
                for at, i in enumerate(z.infolist()):
                    if i.filename.endswith(".txt") and not unsafe_name(i.filename):
                        with z.open(i) as f:
                            yield from ((f"{path}#{at}", *r) for r in rows_of(i.filename[:-4], f))
            else:
                yield from ((path, *r) for r in rows_of(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], io.BytesIO(content)))

        cols = ["file", "table", "_row", "header", "cells", "width", "bad"]
        for b in batches:
            part: list[tuple] = []
            for p, content in zip(b["path"], b["content"]):
                for r in all_rows(p, content):
                    part.append(r)
                    if len(part) >= 20_000:
                        yield pd.DataFrame(part, columns=cols)
                        part = []
            if part:
                yield pd.DataFrame(part, columns=cols)

    got = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, table string, _row long, header array<string>, cells array<string>, width int, bad string")
    return got.select(F.lit(feed).alias("_feed"), "*")


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Table name -> DataFrame of text columns, _feed and _row, from records(). Each file is read by its own header; columns that
    another file of the table has, and required ones, are '' where a file lacks them; of repeated column names the first
    counts. Only the distinct headers are collected."""
    heads = rows.where("_row = 1 and header is not null").select("table", "header").distinct().collect()
    out = {}
    for name in dict.fromkeys(r.table for r in heads):
        mine = sorted(tuple(r.header) for r in heads if r.table == name)
        columns = list(dict.fromkeys([h for header in mine for h in header if h] + REQUIRED.get(name, [])))
        body = rows.where((F.col("table") == name) & (F.col("_row") > 1) & F.col("bad").isNull())
        if len(mine) == 1:
            at = {h: mine[0].index(h) for h in columns if h in mine[0]}
            cols = [F.get("cells", F.lit(at[h])).alias(h) if h in at else F.lit("").alias(h) for h in columns]
        else:
            # A file's header is one small row; it meets the file's records.
            header = rows.where((F.col("table") == name) & (F.col("_row") == 1) & F.col("header").isNotNull()).select("file", F.col("header").alias("_header"))
            body = body.join(F.broadcast(header), "file")
            cols = [F.coalesce(F.try_element_at("cells", F.nullif(F.array_position("_header", h), F.lit(0)).cast("int")), F.lit("")).alias(h) for h in columns]
        out[name] = body.select("_feed", "_row", *cols)
    return out


def structure_findings(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """CSV001 to CSV007 of records(): headers, encodings, widths and empty tables."""
    heads = rows.where("_row = 1 and header is not null")
    t = F.col("table")
    wide = rows.where("_row > 1 and bad is null").join(F.broadcast(heads.select("file", "table", F.size("header").alias("h"))), ["file", "table"]).where("width != h")
    out = [
        row_checks(rows.where("bad is not null"), [(F.col("bad") == "encoding", finding("CSV002", "blocker", "Structure", "", F.col("_row"), t)), ((F.col("bad") == "csv"), finding("CSV002", "blocker", "Structure", "", F.col("_row"), t, F.lit("record that can't be parsed"))), (F.col("bad") == "empty", finding("CSV001", "blocker", "Structure", "", None, t))]),
        row_checks(heads, [(F.array_contains("header", ""), finding("CSV003", "blocker", "Structure", "", None, t)), (F.size("header") != F.size(F.array_distinct("header")), finding("CSV004", "blocker", "Structure", "", None, t))]),
        as_findings(wide, *finding("CSV006", "error", "Structure", "", F.col("_row"), t, F.col("width").cast("string"), F.col("h").cast("string"))),
    ]
    need = spark.createDataFrame([(n, c) for n, cs in REQUIRED.items() for c in cs], "table string, column string")
    lost = heads.join(F.broadcast(need), "table").where(~F.array_contains(F.col("header"), F.col("column")))
    out.append(as_findings(lost, *finding("CSV005", "blocker", "Structure", "", None, t, None, F.col("column"))))
    empty = rows.groupBy("_feed", "file", "table").agg(F.max("_row").alias("n"), F.max("bad").alias("bad")).where("n = 1 and bad is null")
    out.append(as_findings(empty, *finding("CSV007", F.when(t == "calendar_dates", "info").otherwise("blocker"), "Structure", "", None, t)))
    # Findings carry the table as their file.
    return union([o.withColumn("file", F.col("key")).withColumn("key", F.lit(None).cast("string")) for o in out])


def strict_tables(spark: SparkSession, path: str, feed: str) -> dict[str, DataFrame]:
    """tables(), but a record wider than its header, a member that can't be read, a header with blank or repeated names, a member
    that is there twice or a repeated key stops."""
    rows = kept_records(spark, path, feed)
    worst = structure_findings(spark, rows).where("rule_id in ('CSV001', 'CSV002', 'CSV003', 'CSV004') or rule_id = 'CSV006' and cast(observed as int) > cast(expected as int)").limit(1).collect()
    if worst:
        raise ValueError(f"{worst[0].file}: {worst[0].rule_id} in record {worst[0].row}")
    twice = rows.where("_row = 1").groupBy("_feed", "table").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].table} is there twice")
    got = tables(rows)
    for name, key in KEYS.items():
        if name in got and name != "agency":
            again = got[name].groupBy(*[strip(k) for k in key]).count().where("count > 1").limit(1).collect()
            if again:
                raise ValueError(f"{name} repeats the key {', '.join(map(str, again[0][:-1]))}")
    return got


def kept_records(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """records(), parsed once and written to the checkpoint folder, so that every rule reads the parsed table."""
    return cut(records(spark, path, feed))


def log_lines(spark: SparkSession, path: str, most_bytes: int = 8 << 20) -> DataFrame:
    """(path, line_number, message, encoding, warning) of text logs in UTF-16 (with a mark), UTF-8 or, failing that, Windows-1252.

    warning tells that characters were replaced, or that the file is larger than `most_bytes`, which a log by hand hardly is;
    it is read all the same.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"]):
                if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
                    text, enc = raw.decode("utf-16", errors="replace"), "utf-16"
                else:
                    for enc in ("utf-8-sig", "cp1252", ""):
                        try:
                            text = raw.decode(enc) if enc else raw.decode("utf-8", errors="replace")
                            break
                        except UnicodeDecodeError:
                            continue
                told = [w for w, said in (("characters were replaced", not enc), (f"larger than {most_bytes} bytes", len(raw) > most_bytes)) if said]
                lines = text.splitlines()
                for at in range(0, len(lines), 50_000):
                    part = lines[at : at + 50_000]
                    yield pd.DataFrame({"path": p, "line_number": range(at + 1, at + 1 + len(part)), "message": part, "encoding": enc or "utf-8 with losses", "warning": "; ".join(told)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, line_number int, message string, encoding string, warning string")


def from_tables(source: dict[str, DataFrame], feed: str = "feed", row: str = "row_id") -> dict[str, DataFrame]:
    """Tables that hold several feeds in one, put into the shape the operators take."""
    return {n: df.withColumn("_feed", F.coalesce(feed, F.lit(""))).withColumn("_row", F.col(row).cast("bigint")) for n, df in source.items()}
