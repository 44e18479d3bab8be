"""Table files to cells: delimited text, HTML tables and XLSX workbooks, read where Spark puts each file.

Input rows are those of Spark's ``binaryFile`` source (``path, length, content``); size and kind are
filtered on before content is touched.  Output: ``file, sheet, row, col, s`` (text) and ``n`` (number), one row
per cell that isn't blank.  A file that can't be read, for whatever reason, is a row of ``refusals``, never a failed job.
A file is bounded by ``Limits``, so each is one task's small work.
"""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import kept

#: How many cells a reader sends on together, and how many rows it looks through for them.
CELLS_AT_ONCE, ROWS_AT_ONCE = 8192, 1024
CELLS = "file string, sheet string, row int, col int, s string, n double, error string"


@dataclass(frozen=True)
class Limits:
    """What a table file may hold."""

    file_bytes: int = 20 << 20
    part_bytes: int = 50 << 20
    unpacked_bytes: int = 100 << 20
    sheets: int = 50
    columns: int = 256
    rows: int = 100_000


class Refused(ValueError):
    """A file that isn't read, with the reason."""


def decode(content: bytes) -> str:
    """Strict UTF-8 (with or without its mark), else the Thai Windows code page."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp874", errors="replace")


def separator(line: str) -> str:
    """The most frequent of comma, semicolon and tab in the first line; the first of them on a tie."""
    n = Counter(c for c in line if c in ",;\t")
    return max(",;\t", key=lambda c: (n[c], -",;\t".index(c)))


def delimited(content: bytes) -> dict[str, list[list[str]]]:
    text = decode(content).replace("\r\n", "\n").replace("\r", "\n")
    csv.field_size_limit(1 << 30)  # a file's own limit is the bound
    return {"text": list(csv.reader(io.StringIO(text), delimiter=separator(text.split("\n", 1)[0])))}


def html_tables(content: bytes) -> dict[str, list[list[str]]]:
    """Rows of ``tr`` and cells of ``td`` and ``th``; line breaks are blanks, tags go, character references are decoded."""
    rows = []
    for row in re.findall(r"<tr\b.*?(?=</tr|<tr\b|</table|\Z)", decode(content), re.S | re.I):
        cells = re.findall(r"<t[dh]\b[^>]*>(.*?)(?=</t[dh]|<t[dh]\b|\Z)", row, re.S | re.I)
        rows.append([" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br[^>]*>", " ", c))).split()) for c in cells])
    if not rows:
        raise Refused("no table")
    return {"html": rows}


@lru_cache(1024)
def _letters(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _column(ref: str) -> int:
    """The column of a cell's place; without its row a place is one of few."""
    return _letters(ref.rstrip("0123456789"))


@lru_cache(1024)
def _plain(tag: str) -> str:
    """A tag's name without its name space."""
    return tag.rsplit("}", 1)[-1]


#: How a compound file begins, and the stream that an encrypted workbook has in it.
COMPOUND = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
ENCRYPTION = "EncryptionInfo".encode("utf-16-le")


def locked(content: bytes) -> bool:
    """A workbook behind a password is a compound file that says how it is encrypted."""
    return len(content) >= 512 and content.startswith(COMPOUND) and ENCRYPTION in content


def workbook(content: bytes, limits: Limits = Limits()) -> dict[str, list[list]]:
    """An XLSX workbook's sheets in order: shared and inline strings, booleans as text, numbers."""
    if locked(content):
        raise Refused("locked with a password")
    if content[:8] == COMPOUND:
        raise Refused("the old binary spreadsheet kind isn't read")
    try:
        parts = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Refused("not a workbook") from e
    names, unpacked = set(parts.namelist()), 0

    def tree(name: str):
        """A part's XML; what it unpacks to is counted, whatever the archive says, and it may define no entities."""
        nonlocal unpacked
        if name not in names:
            return None
        with parts.open(name) as f:
            data = f.read(limits.part_bytes + 1)
        unpacked += len(data)
        if len(data) > limits.part_bytes or unpacked > limits.unpacked_bytes:
            raise Refused("unpacks to too much")
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise Refused("defines entities")
        return ElementTree.fromstring(data)

    local = lambda e: _plain(e.tag)
    texts = lambda e: "".join([t.text or "" for t in e.iter() if local(t) == "t"])
    strings = tree("xl/sharedStrings.xml")
    shared = [texts(e) for e in strings] if strings is not None else []
    book = tree("xl/workbook.xml")
    if book is None:
        raise Refused("no workbook part")
    if any(local(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter()):
        raise Refused("dates counted from 1904")
    rels = tree("xl/_rels/workbook.xml.rels")
    targets = {e.get("Id"): e.get("Target") for e in (rels if rels is not None else [])}
    out: dict[str, list[list]] = {}
    sheets = [e for e in book.iter() if local(e) == "sheet"]
    if len(sheets) > limits.sheets:
        raise Refused("too many sheets")
    for sheet in sheets:
        target = next((targets[v] for k, v in sheet.attrib.items() if k.endswith("}id") and v in targets), "")
        body = tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        rows: list[list] = []
        for r in [e for e in (body.iter() if body is not None else []) if local(e) == "row"]:
            at = int(r.get("r", len(rows) + 1)) - 1
            if at >= limits.rows:
                raise Refused("too many rows")
            rows += [[] for _ in range(at + 1 - len(rows))]
            row = rows[at]
            for c in r:
                place = c.get("r")
                col = _column(place) if place else len(row)
                if col >= limits.columns:
                    raise Refused("too many columns")
                kind = c.get("t", "n")
                if kind == "inlineStr":
                    v = texts(c)
                else:
                    value = next((x.text or "" for x in c if local(x) == "v"), "") if len(c) != 1 else c[0].text or "" if local(c[0]) == "v" else ""
                    v = shared[int(value)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[value] if kind == "b" else value if kind in ("str", "e") or not value else float(value)
                if col == len(row):
                    row.append(v)
                else:
                    row += [""] * (col + 1 - len(row))
                    row[col] = v
        out[sheet.get("name", f"sheet {len(out) + 1}")] = rows
    return out


def read_one(path: str, content: bytes, limits: Limits) -> dict[str, list[list]]:
    """By extension, and for old spreadsheet names by content (many are HTML or text)."""
    end = path.lower().rsplit(".", 1)[-1]
    if end in ("xlsx", "xlsm"):
        return workbook(content, limits)
    if end in ("htm", "html") or end == "xls" and re.match(rb"\s*(?:\xef\xbb\xbf)?\s*<", content):
        return html_tables(content)
    if locked(content):
        raise Refused("locked with a password")
    if end == "xls" and content.startswith(COMPOUND[:4]):
        raise Refused("the old binary spreadsheet kind isn't read")
    if end in ("csv", "txt", "tsv", "xls"):
        return delimited(content)
    raise Refused("not a table file")


NAMES, KINDS = [c.split()[0] for c in CELLS.split(", ")], [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]


def _read(files: DataFrame, limits: Limits) -> DataFrame:
    """Cells of ``path, content`` rows, all read by one step; a file without content was too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in NAMES]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], NAMES)
        for batch in batches:
            # A file at a time leaves Arrow's memory, and cells of many small files go out together.
            for path, content in zip(*(batch.column(c) for c in ("path", "content")), strict=True):
                path, content = path.as_py(), content.as_py()
                try:
                    if content is None:
                        raise Refused("too large")
                    sheets = read_one(path, content, limits)
                    if sum(map(len, sheets.values())) > limits.rows or any(len(r) > limits.columns for rows in sheets.values() for r in rows):
                        raise Refused("too many rows or columns")
                except Exception as e:  # a reader's errors are many kinds: each is this file's refusal
                    for c, v in zip(columns, (path, None, None, None, None, None, str(e) or type(e).__name__), strict=True):
                        c.append(v)
                    continue
                for name, rows in sheets.items():
                    for first in range(0, len(rows), ROWS_AT_ONCE):
                        found = [(i, j, v) for i, row in enumerate(rows[first : first + ROWS_AT_ONCE], first) for j, v in enumerate(row) if v != ""]
                        n, values = len(found), [v for _, _, v in found]
                        texts, numbers = [None if isinstance(v, float) else v for v in values], [v if isinstance(v, float) else None for v in values]
                        for c, more in zip(columns, ([path] * n, [name] * n, [i for i, _, _ in found], [j for _, j, _ in found], texts, numbers, [None] * n), strict=True):
                            c += more
                        if len(columns[0]) >= CELLS_AT_ONCE:
                            yield made()
                            columns = [[] for _ in NAMES]
        if columns[0]:
            yield made()

    return files.select("path", "content").mapInArrow(run, CELLS)


def cells(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Cells of ``path, length, content`` rows; ``error`` holds a refusal (then the rest is NULL).

    Files that are too large are found by a second look at ``files``, so that a scan never opens them; files that a job makes
    would be made twice by that, see ``made_cells``.
    """
    read = _read(files.where(F.col("length") <= limits.file_bytes), limits)
    large = files.where(F.col("length") > limits.file_bytes)
    gap = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in CELLS.split(", ")[1:-1])]
    too_large = F.when(F.col("length") > limits.file_bytes, "too large").alias("error")
    return read.unionByName(large.select(F.col("path").alias("file"), *gap, too_large))


def made_cells(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``cells`` of files that this job makes: each is made once, and one that is too large goes to the reader without its content."""
    return _read(files.select("path", F.when(F.col("length") <= limits.file_bytes, F.col("content")).alias("content")), limits)


def without_own_files(found: DataFrame) -> DataFrame:
    """``cells`` with this tool's own outputs refused: such a file's cells become one row with the reason.

    A review workbook holds lines that were held back, which must not come in again as a bank's.
    """
    from ..operators.pages import own_file_kind

    kinds = own_file_kind(found.where("error is null").withColumn("text", F.coalesce("s", F.col("n").cast("string"))))
    d = found.join(kinds, "file", "left")
    gone = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in CELLS.split(", ")[1:-1])]
    refused = kinds.select("file", *gone, F.concat(F.lit("this tool's own file: "), "kind").alias("error"))
    return d.where("kind is null").select(*found.columns).unionByName(refused)


def read_tables(spark: SparkSession, path: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Cells and refusals of all files under ``path``."""
    read = kept(cells(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), limits), "cells")
    all_ = without_own_files(read)
    return all_.where("error is null").drop("error"), all_.where("error is not null").select("file", "error")


def positioned_words(rows: DataFrame, own: str = "page") -> DataFrame:
    """Text lines (``page, line, text``) -> words with places in proportion to their characters: page, line, word, x0, x1, text."""
    words = rows.select(own, "line", F.posexplode(F.split("text", " ")).alias("word", "text")).where("text <> ''")
    from pyspark.sql.window import Window as W

    before = F.coalesce(F.sum(F.length("text") + 1).over(W.partitionBy(own, "line").orderBy("word").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return words.withColumn("x0", before.cast("double")).withColumn("x1", F.col("x0") + F.length("text"))
