"""Reports and feeds as files. Rows come to the driver one partition at a time."""

from __future__ import annotations

import csv
import html
import io
import json
import os
import zipfile
from collections.abc import Iterable
from contextlib import contextmanager
from string import ascii_uppercase
from xml.sax.saxutils import XMLGenerator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.contract import DIFF_KEYS, FIELDS
from tramline.functions.scalars import safe_cell
from tramline.plans import ledger

MAX_CELL, MAX_ROWS = 32_767, 1_048_576
STAMP = (2000, 1, 1, 0, 0, 0)


def findings_csv(findings: DataFrame, folder: str) -> None:
    """A folder of CSV parts, cells safe for spreadsheets."""
    findings.select(*[safe_cell(F.col(c).cast("string")).alias(c) for c in ledger.COLUMNS]).write.mode("overwrite").option("header", True).csv(folder)


def findings_sheet(findings: DataFrame, path: str) -> None:
    """One CSV file in the ledger's order, with a byte order mark, cells safe for spreadsheets."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(ledger.COLUMNS)
        for r in ledger.ordered(findings).select(*[safe_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ledger.COLUMNS]).toLocalIterator():
            w.writerow(r)


def report_json(findings: DataFrame, path: str, cap: int | None = None) -> dict:
    """The report as one JSON file: decisions, how many findings a cap leaves out, and findings in the ledger's order.

    Findings are written as they come, one partition at a time; what is returned holds the rest.
    """
    kept, left_out = ledger.capped(findings, cap) if cap else (ledger.ordered(findings), 0)
    body = {"decisions": [r.asDict() for r in ledger.decision(findings).collect()], "suppressed_findings": left_out}
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(body, indent=2, ensure_ascii=False)[:-2] + ',\n  "findings": [')
        for i, r in enumerate(kept.toLocalIterator()):
            f.write(("," if i else "") + "\n    " + json.dumps(r.asDict(), ensure_ascii=False))
        f.write("\n  ]\n}")
    return body


def write_once(body: dict, path: str) -> None:
    """A JSON document in a file that must not exist yet."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(body, f, indent=2, ensure_ascii=False)


def export_csv(rows: DataFrame, path: str) -> None:
    """One CSV file of a table, such as mapped stops or chosen findings, cells safe for spreadsheets."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(rows.columns)
        for r in rows.select(*[safe_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in rows.columns]).toLocalIterator():
            w.writerow(r)


def notices_html(notices: list[dict], path: str, title: str) -> None:
    """A page of another validator's notices - code, severity, totalNotices, sampleNotices - that needs nothing but itself."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>")
        for n in notices:
            f.write(f"<details><summary>{html.escape(str(n.get('severity', '')))} {html.escape(str(n.get('code', '')))} ({int(n.get('totalNotices', 0))})</summary>")
            f.write("".join(f"<pre>{html.escape(json.dumps(x, indent=1, ensure_ascii=False))}</pre>" for x in n.get("sampleNotices", [])) + "</details>")


class BuildHistory:
    """The state of builds in a folder, one JSON file each, replaced as a whole: the last log lines, and the newest builds."""

    def __init__(self, folder: str, lines: int = 120, builds: int = 25):
        self.folder, self.lines, self.builds = folder, lines, builds
        os.makedirs(folder, exist_ok=True)

    def save(self, ident: str, state: dict) -> None:
        kept = state | {"log": list(state.get("log", []))[-self.lines :]}
        part = os.path.join(self.folder, f".{ident}.part")
        with open(part, "w", encoding="utf-8") as f:
            json.dump(kept, f, ensure_ascii=False)
        os.replace(part, os.path.join(self.folder, f"{ident}.json"))
        for old in self._files()[self.builds :]:
            os.remove(old)

    def _files(self) -> list[str]:
        found = [os.path.join(self.folder, n) for n in os.listdir(self.folder) if n.endswith(".json")]
        return sorted(found, key=lambda p: (os.stat(p).st_mtime_ns, p), reverse=True)

    def all(self) -> list[dict]:
        out = []
        for p in self._files():
            with open(p, encoding="utf-8") as f:
                out.append(json.load(f))
        return out


#: Names of a sheet's columns, A to ZZ.
LETTERS = [first + second for first in ("", *ascii_uppercase) for second in ascii_uppercase]
UNPRINTABLE = {code: None for code in range(32) if chr(code) not in "\t\n\r"}
SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
BOOK_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"


@contextmanager
def _document(archive: zipfile.ZipFile, name: str):
    """A writer of one XML member: element(tag, attributes) as a context, leaf() for one without children."""
    with archive.open(name, "w") as raw, io.TextIOWrapper(raw, encoding="utf-8") as text:
        out = XMLGenerator(text, "utf-8", short_empty_elements=True)
        out.startDocument()

        @contextmanager
        def element(tag: str, **attributes: object):
            out.startElement(tag, {k.replace("_", ":"): str(v) for k, v in attributes.items()})
            yield out.characters
            out.endElement(tag)

        yield element
        out.endDocument()


def _line(element, number: int, values: Iterable) -> None:
    with element("row", r=number):
        for letters, value in zip(LETTERS, values):
            shown = ("" if value is None else str(value)).translate(UNPRINTABLE)
            if len(shown) > MAX_CELL:
                raise ValueError(f"cell {letters}{number} has more than {MAX_CELL} characters")
            with element("c", r=f"{letters}{number}", t="inlineStr"), element("is"), element("t", xml_space="preserve") as write:
                write(shown)


def _write_sheet(archive: zipfile.ZipFile, name: str, fields: list[str], rows: Iterable) -> None:
    if len(fields) > len(LETTERS):
        raise ValueError("more columns than a sheet may have here")
    with _document(archive, name) as element, element("worksheet", xmlns=SHEETS):
        with element("sheetViews"), element("sheetView", workbookViewId=0), element("pane", ySplit=1, topLeftCell="A2", state="frozen"):
            pass
        number = 1
        with element("sheetData"):
            _line(element, number, fields)
            for number, row in enumerate(rows, 2):
                if number > MAX_ROWS:
                    raise ValueError(f"{name} has more rows than a sheet may have")
                _line(element, number, row)
        with element("autoFilter", ref=f"A1:{LETTERS[max(len(fields), 1) - 1]}{number}"):
            pass


def write_xlsx(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook of one sheet per DataFrame: all cells text, the header frozen and filtered.

    A cell, or a sheet, longer than the format allows stops the writing; nothing is cut off.
    """
    members = {name: f"worksheets/sheet{i}.xml" for i, name in enumerate(sheets, 1)}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        with _document(z, "[Content_Types].xml") as element, element("Types", xmlns=f"{PACKAGE}/content-types"):
            for extension, kind in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml")):
                with element("Default", Extension=extension, ContentType=kind):
                    pass
            for part, kind in (("workbook.xml", BOOK_TYPE), *((m, SHEET_TYPE) for m in members.values())):
                with element("Override", PartName=f"/xl/{part}", ContentType=kind):
                    pass
        with _document(z, "_rels/.rels") as element, element("Relationships", xmlns=f"{PACKAGE}/relationships"):
            with element("Relationship", Id="rId1", Type=f"{RELATIONS}/officeDocument", Target="xl/workbook.xml"):
                pass
        with _document(z, "xl/workbook.xml") as element, element("workbook", xmlns=SHEETS, xmlns_r=RELATIONS), element("sheets"):
            for i, name in enumerate(sheets, 1):
                with element("sheet", name=name[:31], sheetId=i, r_id=f"rId{i}"):
                    pass
        with _document(z, "xl/_rels/workbook.xml.rels") as element, element("Relationships", xmlns=f"{PACKAGE}/relationships"):
            for i, part in enumerate(members.values(), 1):
                with element("Relationship", Id=f"rId{i}", Type=f"{RELATIONS}/worksheet", Target=part):
                    pass
        for name, df in sheets.items():
            _write_sheet(z, f"xl/{members[name]}", df.columns, df.toLocalIterator())


def write_html(sheets: dict[str, DataFrame], path: str, title: str) -> None:
    """A page that prints: one table per DataFrame."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>")
        for name, df in sheets.items():
            f.write(f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
            for r in df.toLocalIterator():
                f.write("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>")
            f.write("</table>")


def write_feed(tables: dict[str, DataFrame], path: str) -> None:
    """A feed archive that is the same for the same rows: fixed times and modes, tables and rows in order, known fields only.

    The file must not exist; it appears under its name only when it is whole.
    """
    if os.path.exists(path):
        raise FileExistsError(path)
    part = f"{path}.part"
    try:
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            for name, fields in FIELDS.items():
                if name not in tables:
                    continue
                df = tables[name]
                cols = [c for c in fields if c in df.columns]
                info = zipfile.ZipInfo(f"{name}.txt", STAMP)
                info.external_attr = 0o100644 << 16
                info.compress_type = zipfile.ZIP_DEFLATED
                keys = [F.col(k).try_cast("bigint") if k.endswith("sequence") else F.col(k) for k in DIFF_KEYS[name] if k in df.columns]
                with z.open(info, "w") as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as f:
                    w = csv.writer(f, lineterminator="\r\n")
                    w.writerow(cols)
                    for r in (df.select(*cols, *[k.alias(f"_k{i}") for i, k in enumerate(keys)]).orderBy(*[f"_k{i}" for i in range(len(keys))]) if keys else df.select(*cols)).toLocalIterator():
                        w.writerow(["" if v is None else v for v in r[: len(cols)]])
        verify_feed(part)
        os.link(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def verify_feed(path: str) -> None:
    """Stops if a member of the archive is broken, unreadable to others or not at the root."""
    with zipfile.ZipFile(path) as z:
        bad = z.testzip()
        odd = [i.filename for i in z.infolist() if "/" in i.filename or (i.external_attr >> 16) & 0o777 != 0o644]
    if bad or odd:
        raise ValueError(f"archive is not sound: {bad or odd}")
