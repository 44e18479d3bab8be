"""XLSX workbooks, the same bytes for the same rows: one small file per account, written by the task that holds it."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from functools import lru_cache
from itertools import accumulate
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Fixed values of the format: the parts' names and kinds, and the earliest time a ZIP entry can carry.
EARLIEST = (1980, 1, 1, 0, 0, 0)
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


@lru_cache(1024)
def column_name(i: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA: shorter names come first, so what they use up is taken off."""
    width, names = 1, 26
    while i >= names:
        i, width, names = i - names, width + 1, names * 26
    return "".join(chr(65 + i // 26**k % 26) for k in reversed(range(width)))


#: Fixed value: characters that XML 1.0 can't hold, and the carriage return.
CONTROLS = re.compile(r"[\x00-\x08\x0b-\x1f]")


def _said(text: str) -> str:
    """A text's cell after its place."""
    return f'" t="inlineStr"><is><t xml:space="preserve">{escape(CONTROLS.sub("", text))}</t></is></c>'


#: Days and short notes recur from row to row.
_short = lru_cache(4096)(_said)


def _cell(column: str, row: int, v) -> str:
    kind = type(v)
    if kind is int:
        return f'<c r="{column}{row}"><v>{v}</v></c>'
    if v is None or v == "" or v != v:
        return ""
    if isinstance(v, bool) or not isinstance(v, int | float):
        text = v if kind is str else str(v)
        return f'<c r="{column}{row}{_short(text) if len(text) <= 40 else _said(text)}'
    return f'<c r="{column}{row}"><v>{int(v) if float(v).is_integer() else repr(float(v))}</v></c>'


def _table(i: int, rows: list[list]) -> str:
    """An Excel table over a sheet's rows, its first row the headings."""
    ref = f"A1:{column_name(len(rows[0]) - 1)}{len(rows)}"
    columns = "".join(f'<tableColumn id="{c}" name="{escape(str(h), {chr(34): "&quot;"})}"/>' for c, h in enumerate(rows[0], 1))
    return f'<table xmlns="{MAIN}" id="{i}" name="Table{i}" displayName="Table{i}" ref="{ref}"><autoFilter ref="{ref}"/><tableColumns count="{len(rows[0])}">{columns}</tableColumns></table>'


def workbook(sheets: dict[str, list[list]], tables: frozenset[str] = frozenset()) -> bytes:
    """Stored parts in a fixed order with a fixed time; sheets named in ``tables`` hold their rows as an Excel table, if there are any."""
    number = {name: i for i, name in enumerate((n for n, rows in sheets.items() if n in tables and len(rows) > 1), 1)}
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        + "".join(f'<Override PartName="/xl/tables/table{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml"/>' for i in number.values()) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for i, (name, rows) in enumerate(sheets.items(), 1):
        own = '<tableParts count="1"><tablePart r:id="rId1"/></tableParts>' if name in number else ""
        if name in number:
            parts[f"xl/tables/table{number[name]}.xml"] = _table(number[name], rows)
            parts[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/table" Target="../tables/table{number[name]}.xml"/></Relationships>'
        columns = [column_name(c) for c in range(max(map(len, rows), default=0))]
        body = "".join([f'<row r="{r}">{"".join([_cell(c, r, v) for c, v in zip(columns, row)])}</row>' for r, row in enumerate(rows, 1)])  # noqa: B905
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{body}</sheetData>{own}</worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, EARLIEST), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return out.getvalue()


def files(rows: DataFrame, key: str, order: list[str], columns: list[str], sheet: str = "rows") -> DataFrame:
    """One row per ``key``: ``path, length, content`` of a workbook with a heading row and the key's rows in order.

    An account holds at most what a statement may (see ``sources.tables.Limits``).
    """

    def one(k: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        body = [[None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r] for r in group[columns].itertuples(index=False)]
        content = workbook({sheet: [columns, *body]})
        return pd.DataFrame([(f"{k[0]}.xlsx", len(content), content)], columns=["path", "length", "content"])

    return rows.groupBy(key).applyInPandas(one, "path string, length bigint, content binary")


def review_files(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per ``key``: a review workbook of transactions (an Excel table), days and proof.

    Rows: ``key, stmt_id, seq, day`` (text), ``amount, verified``; a key's rows are bounded by what a file may hold.
    """

    def one(k: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in order])
        lines = list(zip(*(group.column(c).to_pylist() for c in ("stmt_id", "seq", "day", "amount")), strict=True))
        found = Counter(day for _, _, day, _ in lines)
        days = [[d, found[d]] for d in sorted(found, key=lambda d: (d is None, d or ""))]
        proved = pc.sum(group.column("verified")).as_py() or 0
        sheets = {
            "Transactions": [["account", "line", "day", "amount"], *lines], "Daily": [["day", "lines"], *days],
            "Proof": [["what", "lines"], ["proved", proved], ["to check", len(lines) - proved]],
        }
        content = workbook(sheets, frozenset({"Transactions"}))
        return pa.table({"path": [f"{k[0].as_py()}.xlsx"], "length": pa.array([len(content)], pa.int64()), "content": pa.array([content], pa.binary())})

    return rows.select(key, "stmt_id", "seq", "day", "amount", "verified").groupBy(key).applyInArrow(one, "path string, length bigint, content binary")


def sheet_files(lines: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """One row per ``key``: ``path, length, content`` of a workbook with the sheets of ``order``.

    Lines: ``key, sheet, part, place, cells`` (arrays of ``s`` and ``n``, see ``operators.review.sheets``); the same bytes whatever order they come in.
    """

    def one(k: tuple, group: pa.Table) -> pa.Table:
        cells = group.column("cells").combine_chunks()
        flat = cells.flatten()
        values = [n if s is None else s for s, n in zip(flat.field("s").to_pylist(), flat.field("n").to_pylist(), strict=True)]
        ends = list(accumulate(pc.list_value_length(cells).to_pylist(), initial=0))
        names, parts, places = (group.column(c).to_pylist() for c in ("sheet", "part", "place"))
        sheets: dict[str, list[list]] = {name: [] for name in order}
        for i in sorted(range(len(names)), key=lambda i: (parts[i], places[i])):
            if names[i] in sheets:
                sheets[names[i]].append(values[ends[i] : ends[i + 1]])
        content = workbook(sheets, frozenset())
        return pa.table({"path": [f"{k[0].as_py()}.xlsx"], "length": pa.array([len(content)], pa.int64()), "content": pa.array([content], pa.binary())})

    return lines.select(key, "sheet", "part", "place", "cells").groupBy(key).applyInArrow(one, "path string, length bigint, content binary")
