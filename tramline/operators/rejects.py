"""Rows that fail to parse, apart from the valid ones, each with its reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.common import strip

#: Stand-ins for a comma inside a quoted cell, and for the stand-in's own mark where the text has it.
MARK, COMMA, OWN = "\x01", "\x01a", "\x01b"


def _rules() -> dict[str, object]:
    whole = r"^[0-9]+$"
    clock = r"^(?:[0-9]{1,3}:[0-5][0-9]:[0-5][0-9])?$"
    return {
        "stop_sequence": lambda v: v.rlike(whole),
        "arrival_time": lambda v: v.rlike(clock),
        "start_date": lambda v: v.rlike(r"^[0-9]{8}$") & F.try_to_date(v, "yyyyMMdd").isNotNull(),
    }


#: Field -> predicate of a trimmed value that holds where the value is valid.
VALUE_RULES = _rules()


def value_errors(fields: dict[str, Column]) -> Column:
    """Array of the fields whose trimmed value breaks its rule; a null column counts as not checked."""
    return F.array_compact(F.array(*[F.when(c.isNotNull() & ~VALUE_RULES[f](c), F.lit(f)) for f, c in fields.items()]))


def checked_table(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows with _errors, the fields of `fields` whose value is not valid; every column is text, null and '' are the same."""
    return rows.withColumn("_errors", value_errors({f: strip(f) for f in fields}))


def split_table(rows: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The valid rows, their columns still text, and the failing rows with _errors; together all rows."""
    checked = checked_table(rows, fields)
    return checked.where("size(_errors) = 0").drop("_errors"), checked.where("size(_errors) > 0")


def parsed_line(line: Column, header: bool = False) -> Column:
    """struct(quoted_well, cells): the cells of one record; cells is only right where quoted_well holds.

    One carriage return at the end is ignored, and a byte order mark before a header.

    Splitting at quotes leaves texts that are outside quotes at even places and inside at odd ones.  A record is well
    quoted if the last place is an even one and each outside text between two quotes is empty (a doubled quote) or
    begins and ends with a comma; the first must be empty or end with one, the last be empty or begin with one.
    """
    text = F.regexp_replace(F.coalesce(line, F.lit("")), r"^\x{feff}|\r\z" if header else r"\r\z", "")
    bare = ~text.contains('"')
    marked = F.when(text.contains(MARK), F.replace(text, F.lit(MARK), F.lit(OWN))).otherwise(text)
    parts = F.split(marked, '"', -1)
    last = F.size(parts) - 1
    ok = F.forall(
        F.transform(parts, lambda x, i: (i % 2 == 1) | (x == "") | (((i == 0) | x.startswith(",")) & ((i == last) | x.endswith(",")))),
        lambda x: x,
    )
    well = bare | ((last % 2 == 0) & ok)
    flat = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(","), F.lit(COMMA))).otherwise(x)), '"')
    cells = F.when(bare, F.split(marked, ",", -1)).otherwise(F.split(flat, ",", -1))
    return F.struct(well.alias("quoted_well"), cells.alias("cells"))


def cell_value(cell: Column) -> Column:
    """A cell without its quotes, with doubled quotes and stand-ins resolved."""
    inner = F.when(cell.startswith('"'), F.replace(F.substring(cell, F.lit(2), F.greatest(F.length(cell) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(cell)
    return F.when(inner.contains(MARK), F.replace(F.replace(inner, F.lit(COMMA), F.lit(",")), F.lit(OWN), F.lit(MARK))).otherwise(inner)


def checked_lines(lines: DataFrame, fields: list[str] | None = None, block: int = 65536) -> DataFrame:
    """(row_id, file_id, line_number, names, values, reason) per record; reason is '' for a valid one, else quoting, columns or value.

    Line 1 of a file is its header and gives no row.  Headers meet records by file and block of line numbers, so a file
    that holds most of all lines is spread over tasks.  A file without a header has a header of no cells: its records
    fail on columns.  A null line is a line of one empty cell.  Rows without file or line number are left out.
    """
    fields = fields or list(VALUE_RULES)
    rows = lines.select(F.col("row_id").cast("bigint").alias("row_id"), "file_id", F.col("line_number").cast("bigint").alias("line_number"), "line").where("file_id is not null and line_number is not null")
    rows = rows.withColumn("blk", F.floor(F.col("line_number") / block))
    head = rows.where("line_number = 1").withColumn("p", parsed_line(F.col("line"), header=True))
    names = F.transform("p.cells", lambda c: F.lower(strip(cell_value(c))))
    head = head.groupBy("file_id").agg(F.min(names).alias("names"))
    blocks = rows.where("line_number > 1").select("file_id", "blk").distinct().join(head, "file_id", "left")
    body = rows.where("line_number > 1").join(blocks, ["file_id", "blk"]).withColumn("p", parsed_line(F.col("line")))
    names = F.coalesce("names", F.array().cast("array<string>"))
    place = {f: F.array_position(names, f) for f in fields}
    value = {f: F.when(place[f] > 0, strip(cell_value(F.try_element_at("p.cells", place[f].cast("int"))))) for f in fields}
    reason = F.when(~F.col("p.quoted_well"), "quoting").when(F.size("p.cells") != F.size(names), "columns").when(F.size(value_errors(value)) > 0, "value").otherwise("")
    return body.select("row_id", "file_id", "line_number", names.alias("names"), "p.cells", reason.alias("reason"))


def loaded_lines(checked: DataFrame) -> DataFrame:
    """(row_id, file_id, line_number, record): the valid records of checked_lines, all of them; record maps column names to text.

    Of columns with one name the first counts; columns without a name are under ''.
    """
    at = F.transform(F.array_distinct("names"), lambda n: F.array_position("names", n).cast("int"))
    values = F.map_from_arrays(F.array_distinct("names"), F.transform(at, lambda i: cell_value(F.try_element_at("cells", i))))
    return checked.where("reason = ''").select("row_id", "file_id", "line_number", values.alias("record"))


def typed(value: Callable[[str], Column]) -> list[Column]:
    """The checked fields of a valid row in types: sequence, a whole number without leading zeros (text, as it may be of any
    length), arrival_s, seconds of the service day, and start_day; null where the row has no such field or it is blank."""
    parts = lambda i: F.split(value("arrival_time"), ":")[i].cast("int")
    return [
        F.regexp_replace(value("stop_sequence"), "^0+(?=[0-9])", "").alias("sequence"),
        F.when(value("arrival_time") != "", parts(0) * 3600 + parts(1) * 60 + parts(2)).alias("arrival_s"),
        F.try_to_date(value("start_date"), "yyyyMMdd").alias("start_day"),
    ]
