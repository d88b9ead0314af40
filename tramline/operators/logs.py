"""Log lines of several programs into entries with time, severity, component and message.

A line that matches one of the record-start patterns begins an entry; the lines up to the next beginning belong to it.
The lines of a log are cut into blocks of line numbers: the cumulative grouping runs inside a block, and the beginning that
is open at a block's end is carried to the next blocks through one small row per block.  So a log that holds most of all
lines is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.common import cut

SEP = "\x01"

#: Severity words and abbreviations by level, in English and French.
SEVERITY = {
    "DEBUG": ["debug", "dbg", "trace", "verbose", "débogage", "d", "v", "t"],
    "INFO": ["info", "inf", "information", "informational", "notice", "note", "remarque", "i", "n"],
    "WARNING": ["warning", "warn", "wrn", "avertissement", "avert", "attention", "w"],
    "ERROR": ["error", "err", "erreur", "severe", "e"],
    "FATAL": ["fatal", "fatale", "critical", "crit", "critique", "panic", "emerg", "emergency", "alert", "f", "c"],
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_MON = "(?i:" + "|".join(MONTHS) + ")"
_WORDS = "(?i:" + "|".join(sorted((w for ws in SEVERITY.values() for w in ws if len(w) > 2), key=len, reverse=True)) + ")"
_ISO = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"
_DMY = r"\d{1,2}/\d{1,2}/\d{4}[ T]\d{2}:\d{2}:\d{2}"
_FRACTION = r"(?:[.,]\d+)?"
_ZONE = r"(?: ?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?"
_COMPONENT = r"(?:\[\d+\]|\(\s*\d+\))?"
_TIME = rf"{_ISO}|{_DMY}|\d{{8}} \d{{6}}|\d{{2}}/{_MON}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}|{_MON} {{1,2}}\d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}}|\d{{9,10}}(?:\.\d+)?(?=\s)"
_STATED = rf"^(?:{_ISO}|{_DMY}|\d{{9,10}})"

#: The cascade: per first character of a line (digit, bracket, letter, brace) the patterns in the order in which they are tried;
#: each names the fields it states.
PATTERNS: dict[str, tuple[str, tuple[str, ...]]] = {
    "iso_dash": (rf"^(?<time>{_ISO}){_FRACTION}{_ZONE}\s+\[?(?<level>\p{{L}}+)\s*\]?\s+\[?(?<component>[^\s\[\]()]+){_COMPONENT}\s*\]?\s+-\s+(?<message>.*)$", ("time", "level", "component", "message")),
    "dmy_dash": (rf"^(?<time>{_DMY}){_FRACTION}{_ZONE}\s+-\s+(?<level>\p{{L}}+)\s*-\s+(?<component>[^\s\[\]()]+){_COMPONENT}\s+-\s+(?<message>.*)$", ("time", "level", "component", "message")),
    "columns": (rf"^(?<time>\d{{8}} \d{{6}}){_FRACTION}\|\s*(?<level>\p{{L}}+)\s*\|\s*(?<component>[^|]*?){_COMPONENT}\s*\|(?<message>.*)$", ("time", "level", "component", "message")),
    "epoch": (r"^(?<time>\d{9,10})(?:\.\d+)?\s+(?<level>\p{L})/(?<component>[^\s():]+)\s*(?:\(\s*\d+\))?:\s*(?<message>.*)$", ("time", "level", "component", "message")),
    "bracketed": (rf"^\[(?<time>{_ISO}){_FRACTION}{_ZONE}\]\s*\[\s*(?<level>\p{{L}}+)\s*\]\s*\[\s*(?<component>[^\s\]]+)\s*\]\s*(?<message>.*)$", ("time", "level", "component", "message")),
    "access": (rf"^\[(?<time>\d{{2}}/{_MON}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}){_ZONE}\]\s+(?<component>[^\s\[\]()]+){_COMPONENT}\s+(?<level>\p{{L}}+)\s*:\s*(?<message>.*)$", ("time", "level", "component", "message")),
    "daemon": (rf"^(?<time>{_MON} {{1,2}}\d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}})\s+\S+\s+(?<component>[^\s\[\]():]+){_COMPONENT}:\s*(?<message>.*)$", ("time", "component", "message")),
    "pairs": (r"^[\p{L}_][\p{L}\d_.]*=", ("time", "level", "component", "message")),
    "json": (r"^\{.*\}\s*$", ("time", "level", "component", "message")),
    "time_only": (rf"^\[?(?<time>{_TIME}){_FRACTION}{_ZONE}\]?\s*(?<message>.*)$", ("time", "message")),
    "severity": (rf"^(?<level>{_WORDS})[ \xa0\u202f]*:\s*(?<message>.*)$", ("level", "message")),
}
CASCADE = [(r"^\d", ("iso_dash", "dmy_dash", "columns", "epoch", "time_only")), (r"^\[", ("bracketed", "access", "time_only")), (r"^\p{L}", ("daemon", "pairs", "time_only", "severity")), (r"^\{", ("json",))]
#: What begins an entry: a line opening with a time, or with a severity word and a colon.
_OPENS = rf"^(?:\[?(?:{_TIME})|{_WORDS}[ \xa0\u202f]*:)"

_PAIR_VALUE = r'(?:"([^"]*)"|(\S+))'
_KEYS = {"time": ["time", "timestamp", "ts", "date", "at"], "level": ["level", "lvl", "severity", "sev"], "component": ["component", "logger", "mod", "module", "comp", "source"], "message": ["message", "msg", "text"]}


def _pair(bare: Column, field: str) -> Column:
    """The value of the first key of that field in a line of key=value pairs."""
    p = rf"(?:^|\s)(?i:{'|'.join(_KEYS[field])})=" + _PAIR_VALUE
    return F.concat(F.regexp_extract(bare, p, 1), F.regexp_extract(bare, p, 2))


def _flat(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{feff}|[\r\n]+$", "")


def _without_message(flat: Column) -> Column:
    """A line of key=value pairs without its quoted message, in which anything may stand."""
    return F.regexp_replace(flat, r'(^|\s)(?i:msg|message|text)="[^"\\]*+(?:\\.[^"\\]*+)*+"', "$1")


def _json(flat: Column, fields: list[str]) -> dict[str, Column]:
    keys = [k for f in fields for k in _KEYS[f]]
    parsed = F.from_json(flat, "struct<" + ",".join(f"`{k}`:string" for k in keys) + ">")
    return {f: F.coalesce(*[parsed[k] for k in _KEYS[f]], F.lit("")) for f in fields}


def begins(flat: Column) -> Column:
    """Whether a line begins an entry."""
    pairs = flat.rlike(PATTERNS["pairs"][0]) & _pair(_without_message(flat), "time").rlike(_STATED)
    return F.when(flat.rlike(r"^[\p{L}\d\[]"), flat.rlike(_OPENS) | (flat.rlike(r"^\p{L}") & pairs)).otherwise(flat.startswith("{") & _json(flat, ["time"])["time"].rlike(_STATED))


def _line_fields(flat: Column) -> Column:
    """struct(time, level, component, message) of a line that begins an entry, all '' where it states none."""
    none = {f: F.lit("") for f in _KEYS}
    made = lambda values: F.struct(*[(none | values)[f].alias(f) for f in _KEYS])
    said = _without_message(flat)
    pairs = {f: _pair(said, f) for f in ("time", "level", "component")}
    pairs["message"] = F.regexp_extract(flat, r'(?:^|\s)(?i:msg|message|text)="([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    whole = None
    for opening, names in CASCADE:
        chain = None
        for name in names:
            pattern, fields = PATTERNS[name]
            if name == "pairs":
                hit, got = flat.rlike(pattern) & pairs["time"].rlike(_STATED), made(pairs)
            elif name == "json":
                hit, got = F.lit(True), made(_json(flat, list(_KEYS)))
            else:
                parts = F.split(F.regexp_replace(flat, "(?s)" + pattern, SEP.join(f"${{{f}}}" for f in fields)), SEP, len(fields))
                hit, got = flat.rlike("(?s)" + pattern), made({f: parts[i] for i, f in enumerate(fields)})
            chain = F.when(hit, got) if chain is None else chain.when(hit, got)
        whole = F.when(flat.rlike(opening), chain) if whole is None else whole.when(flat.rlike(opening), chain)
    return whole


def _clock(raw: Column, year_of: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss as written; '' if there is none."""
    pad = lambda c: F.lpad(c, 2, "0")
    month = lambda c: pad((F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(c))).cast("string"))
    iso = F.concat(F.substring(raw, 1, 10), F.lit(" "), F.substring(raw, 12, 8))
    g = lambda p, i: F.regexp_extract(raw, p, i)
    n = r"^(\d{4})(\d{2})(\d{2}) (\d{2})(\d{2})(\d{2})"
    d, a, s = r"^(\d+)/(\d+)/(\d{4})[ T](\d{2}:\d{2}:\d{2})", r"^(\d+)/(\p{L}+)/(\d{4}):(\d{2}:\d{2}:\d{2})", r"^(\p{L}+) +(\d+) (\d{2}:\d{2}:\d{2})"
    return (
        F.when(raw.rlike(r"^\d{4}-"), iso)
        .when(raw.rlike(d), F.concat(g(d, 3), F.lit("-"), pad(g(d, 2)), F.lit("-"), pad(g(d, 1)), F.lit(" "), g(d, 4)))
        .when(raw.rlike(a), F.concat(g(a, 3), F.lit("-"), month(g(a, 2)), F.lit("-"), pad(g(a, 1)), F.lit(" "), g(a, 4)))
        .when(raw.rlike(s), F.concat(F.coalesce(year_of, F.lit("0000")), F.lit("-"), month(g(s, 1)), F.lit("-"), pad(g(s, 2)), F.lit(" "), g(s, 3)))
        .when(raw.rlike(n), F.regexp_replace(raw, n + "$", "$1-$2-$3 $4:$5:$6"))
        .otherwise(F.lit(""))
    )


def _epoch_utc(raw: Column) -> Column:
    """Seconds since 1970 as UTC, whatever the session's time zone."""
    n = F.regexp_extract(raw, r"^(\d{9,10})", 1).try_cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(n / 86400).cast("int"))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    rest = F.pmod(n, F.lit(86400))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60))


def severity(word: Column) -> Column:
    """One of DEBUG, INFO, WARNING, ERROR, FATAL for a word or abbreviation in any case; '' if it is none."""
    low = F.lower(F.trim(word))
    out = None
    for level, words in SEVERITY.items():
        out = F.when(low.isin(words), level) if out is None else out.when(low.isin(words), level)
    return out.otherwise("")


def log_entries(lines: DataFrame, log: str = "log_id", line: str = "line_number", text: str = "message", loaded: str = "loaded_at", block: int = 4096, with_message: bool = True) -> DataFrame:
    """One row per entry: log, first_line, last_line, logged_at, severity, component and, if asked for, message.

    last_line is the entry's last line that is not blank.  message holds the first line's message and the continuation
    lines, parted by line ends, without blank lines at the end.  Lines before a log's first entry belong to none.
    Rows whose log or line number is null are left out; a null text is a blank line; of repeated line numbers the
    beginning that sorts last counts.  Further columns are ignored.
    """
    flat = _flat(F.coalesce(F.col(text), F.lit("")))
    rows = lines.select(F.col(log).alias("log"), F.col(line).cast("bigint").alias("n"), flat.alias("t"), F.date_format(F.col(loaded), "yyyy").alias("y")).where("log is not null and n is not null")
    # Only what is needed of a line is shuffled: the text of beginnings, whose fields are found at the end, once per entry.
    rows = rows.withColumn("blk", F.floor(F.col("n") / block)).withColumn("starts", begins(F.col("t"))).withColumn("filled", F.col("t").rlike(r"[^\s\x{a0}]"))
    if not with_message:
        rows = rows.withColumn("t", F.when(F.col("starts"), F.col("t")))
    w = W.partitionBy("log", "blk").orderBy("n").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("first", F.last(F.when(F.col("starts"), F.col("n")), ignorenulls=True).over(w))
    aggs = [F.max(F.when(F.col("filled"), F.col("n"))).alias("last"), F.max(F.when(F.col("starts"), F.struct("t", "y"))).alias("head")]
    if with_message:
        aggs.append(F.collect_list(F.when(~F.col("starts"), F.struct("n", "t"))).alias("body"))
    pieces = cut(rows.groupBy("log", "blk", "first").agg(*aggs))  # read twice below
    body = ["body"] if with_message else []
    # The part of a block before its first beginning goes to the beginning that is open at the end of an earlier block.
    ends = pieces.groupBy("log", "blk").agg(F.max("first").alias("open"), F.max(F.when(F.col("first").isNull(), F.struct("last", *body))).alias("lead"))
    carried = ends.withColumn("first", F.last("open", ignorenulls=True).over(W.partitionBy("log").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)))
    carried = carried.where("lead is not null and first is not null").select("log", "first", "lead.last", F.lit(None).cast(pieces.schema["head"].dataType).alias("head"), *[F.col("lead.body")] * with_message)
    whole = pieces.where("first is not null").select("log", "first", "last", "head", *body).unionByName(carried)
    found = whole.groupBy("log", "first").agg(F.max("last").alias("last"), F.max("head").alias("head"), *([F.array_sort(F.flatten(F.collect_list("body"))).alias("body")] if with_message else []))
    found = found.select("log", "first", "last", *body, "head.y", _line_fields(F.col("head.t")).alias("h"))
    h = F.col("h")
    at = F.when(h["time"].rlike(r"^\d{9,10}(?:\.|$)"), _epoch_utc(h["time"])).otherwise(_clock(h["time"], F.col("y")))
    out = found.select(F.col("log").alias(log), F.col("first").alias("first_line"), F.coalesce("last", "first").alias("last_line"), at.alias("logged_at"), severity(h["level"]).alias("severity"), F.trim(h["component"]).alias("component"), *body, *([h["message"].alias("said")] if with_message else []))
    if with_message:
        kept = F.filter("body", lambda x: x["n"] <= F.col("last_line"))
        out = out.withColumn("message", F.array_join(F.concat(F.array("said"), F.transform(kept, lambda x: x["t"])), "\n")).drop("body", "said")
    return out
