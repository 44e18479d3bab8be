"""Text helpers: headings, accounts, file names, remarks, glue between wrapped lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THAI = "[\u0e00-\u0e7f]"
#: Characters that stand for hidden digits in printed account numbers.
MASKS = "xX*"


def squash(c: Column) -> Column:
    """Lower case, without white space and underscores."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s_]+", ""))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"[^\\/]*\z", 0)


def looks_like_account(c: Column) -> Column:
    """10 to 12 digits or masked ones, in groups; a masked one shows 6 digits at least."""
    marks = F.regexp_replace(c, r"[\s-]", "")
    shown = F.length(F.regexp_replace(marks, "[^0-9]", ""))
    whole = marks.rlike(r"^[0-9xX*]{10,12}\z")
    return whole & F.when(marks.rlike("[xX*]"), shown >= 6).otherwise(F.lit(True))


def mask_account(c: Column) -> Column:
    """The last four digits or masked ones."""
    return F.right(F.regexp_replace(c, f"[^0-9{MASKS}]", ""), F.lit(4))


def remark(*fields: Column, most: int = 50) -> Column:
    """The first field that isn't blank, cut to ``most`` code points."""
    return F.left(F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields], F.lit("")), F.lit(most))


def glue(pieces: Column) -> Column:
    """Wrapped lines as one: a blank between, none between two Thai letters."""
    between = lambda a, b: F.when((a == "") | (F.right(a, F.lit(1)).rlike(THAI) & F.left(b, F.lit(1)).rlike(THAI)), "").otherwise(" ")
    return F.aggregate(pieces, F.lit(""), lambda a, b: F.concat(a, between(a, b), b))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def column_letter(c: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, 701 -> ZZ, 702 -> AAA."""
    letter = lambda n: F.chr(F.lit(65) + (n % 26))
    second, third = F.floor(c / 26) - 1, F.floor((F.floor(c / 26) - 1) / 26) - 1
    return F.concat(F.when(third >= 0, letter(third)).otherwise(""), F.when(second >= 0, letter(second)).otherwise(""), letter(c))
