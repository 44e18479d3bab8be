"""Money as integer minor units (BIGINT): strict and tolerant readers, and printed forms. Unreadable is NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an amount as statements print it, grouped or plain, with exactly two decimals.
PRINTED = r"^(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}\z"
#: Fixed value: a cell's amount once units and brackets are off: sign, figure, trailing minus, side.
SIGNED_CELL = r"(?i)^([+*-]?)((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?)(-?)(dr|cr|)\z"
#: Fixed value: a cell's plain figure, with nothing that a unit, bracket, side or blank could add.
PLAIN_CELL = r"^-?\d{1,15}(?:\.\d{2})?\z"
#: Thai digits, and the units that stand beside amounts.
THAI_DIGITS, WESTERN_DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
UNITS = "(?i)฿|thb|บาท"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it occurs there."""
    return F.transform(F.array(value), body)[0]


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"\A(?U:\s)+|(?U:\s)+\z", "")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[,.]", "").try_cast("bigint")


def parse_amount(c: Column) -> Column:
    """'10,000.00' -> 1000000; anything that isn't printed money -> NULL."""
    return F.when(c.rlike(PRINTED), _digits(c))


def parse_signed(c: Column) -> Column:
    """As ``parse_amount``, with a leading minus allowed."""
    body = F.regexp_replace(c, "^-", "")
    return F.when(body.rlike(PRINTED), F.when(c.startswith("-"), -_digits(body)).otherwise(_digits(body)))


def fmt_money(c: Column) -> Column:
    """-5 -> '-0.05'."""
    return F.concat(F.when(c < 0, "-").otherwise(""), _whole(c).cast("string"), F.lit("."), _part(c))


def _whole(c: Column) -> Column:
    return ((F.abs(c) - F.abs(c) % 100) / 100).cast("bigint")


def _part(c: Column) -> Column:
    return F.lpad((F.abs(c) % 100).cast("string"), 2, "0")


def fmt_comma(c: Column) -> Column:
    """-1234567 -> '-12,345.67'."""
    return F.concat(F.when(c < 0, "-").otherwise(""), F.format_number(_whole(c), 0), F.lit("."), _part(c))


def shortest(c: Column) -> Column:
    """The shortest decimal with at least one place: 150 -> '1.5', 200 -> '2.0', never in scientific form."""
    return F.regexp_replace(fmt_money(c), r"0\z", "")


def sum_text(total: Column, count: Column) -> Column:
    """A printed sum; that of no values is '0'."""
    return F.when(count == 0, F.lit("0")).otherwise(fmt_money(F.coalesce(total, F.lit(0))))


def money_cell(c: Column) -> Column:
    """A spreadsheet's money text -> struct(cents, sign, bad, blank).

    Brackets, Dr and a minus at either end mean '-', Cr and a plus '+'; a star, units and Thai
    digits are taken off.  More than two decimals, or blanks between digits, make it ``bad``.
    """

    def read(plain: Column) -> Column:
        inner = plain.rlike(r"\d(?U:\s)+\d")
        t = F.translate(F.regexp_replace(plain, r"(?U)\s+", ""), THAI_DIGITS, WESTERN_DIGITS)
        return let(F.struct(inner.alias("inner"), t.alias("t")), lambda a: let(F.regexp_replace(a["t"], r"^\((.*)\)\z", "$1"), lambda u: figure(a["inner"], a["t"], u)))

    def figure(inner: Column, t: Column, u: Column) -> Column:
        blank = t.isin("", "-", "–") & ~inner
        good = u.rlike(SIGNED_CELL) & ~inner & ~blank
        parts = F.split(F.regexp_replace(u, SIGNED_CELL, "$1|$2|$3|$4"), r"\|")
        return let(F.struct(blank.alias("blank"), good.alias("good"), parts.alias("parts")), lambda a: told(t, a["blank"], a["good"], a["parts"]))

    def told(t: Column, blank: Column, good: Column, parts: Column) -> Column:
        head, tail, side = F.get(parts, F.lit(0)), F.get(parts, F.lit(2)), F.lower(F.get(parts, F.lit(3)))
        sign = F.when(tail == "-", "-").when(head.isin("+", "-"), head).when(side == "dr", "-").when(side == "cr", "+").when(t.startswith("("), "-")
        whole = lambda a: a[0].try_cast("bigint") * 100 + F.rpad(F.coalesce(F.get(a, F.lit(1)), F.lit("")), 2, "0").try_cast("bigint")
        cents = let(F.split(F.replace(F.get(parts, F.lit(1)), F.lit(","), F.lit("")), r"\."), whole)
        return F.struct(F.when(good, cents).alias("cents"), F.when(good, sign).alias("sign"), F.when(~good & ~blank, c).alias("bad"), blank.alias("blank"))

    # Most cells are empty or plain figures: those are read without the patterns that the others need.
    digits = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit("-"), F.lit("")).try_cast("bigint")
    none = F.lit(None).cast("string")
    made = lambda cents, sign, blank: F.struct(cents.alias("cents"), sign.alias("sign"), none.alias("bad"), F.lit(blank).alias("blank"))
    plain = made(F.when(F.contains(c, F.lit(".")), digits).otherwise(digits * 100), F.when(F.startswith(c, F.lit("-")), F.lit("-")), False)
    return (
        F.when(F.coalesce(c == "", F.lit(True)), made(F.lit(None).cast("bigint"), none, True)).when(c.rlike(PLAIN_CELL), plain)
        .otherwise(let(trim(F.regexp_replace(trim(F.coalesce(c, F.lit(""))), UNITS, "")), read))
    )


def repair_money(c: Column) -> Column:
    """An optical reading's money with its separators put right: dots for commas, or punctuation lost before two decimals."""
    digits = F.regexp_replace(c, "[.,]", "")
    grouped = F.concat(F.format_number(digits.substr(F.lit(1), F.length(digits) - 2).try_cast("bigint"), 0), F.lit("."), F.right(digits, F.lit(2)))
    return F.when(c.rlike(r"^\d{1,3}(?:[.,]\d{3})*[.,]\d{2}\z|^\d{3,12}\z"), grouped).otherwise(c)
