"""Dates of two calendars: never guessed.  What can't be read is NULL, with a note that says why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import let

#: The Buddhist year less the Western one; day 0 of spreadsheet dates.
BUDDHIST = 543
SPREADSHEET_EPOCH = "1899-12-30"
#: Month names as statements print them.
MONTHS = {
    **{m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)},
    **{m: i for i, m in enumerate("ม.ค. ก.พ. มี.ค. เม.ย. พ.ค. มิ.ย. ก.ค. ส.ค. ก.ย. ต.ค. พ.ย. ธ.ค.".split(), 1)},
}
DAY_MONTH_YEAR = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?!\w)"
YEAR_MONTH_DAY = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
WESTERN_ISO = r"^(?:19|20)\d{2}-\d{2}-\d{2}\z"
NAMED_MONTH = r"(?i)^(\d{1,2})[ -]?([a-z]{3}|[ก-๎]{1,3}\.[ก-๎]{1,2}\.?)[a-z]*[ -]?(\d{4}|\d{2})\z"


def part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def real_date(y: Column, m: Column, d: Column) -> Column:
    """A DATE, or NULL where the calendar has no such day."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def western(y: Column) -> Column:
    """A four-digit year: 2500 and later is Buddhist."""
    return F.when(y >= 2500, y - BUDDHIST).otherwise(y)


def full_year(y: Column) -> Column:
    """A cell's year: 2400 and later Buddhist, two digits from 60 on Buddhist (68 is 2025), below Western."""
    return F.when(y >= 2400, y - BUDDHIST).when(y >= 1900, y).when((y < 100) & (y >= 60), y + 2500 - BUDDHIST).when(y < 100, y + 2000)


def resolve_year(yy: Column, first: Column, last: Column) -> Column:
    """A two-digit year -> struct(year, note): of its Western and Buddhist readings, the one within a year of the period."""
    fits = F.array_distinct(
        F.filter(F.array(yy + 2000, yy + 2500 - BUDDHIST), lambda y: (y >= F.year(first) - 1) & (y <= F.year(last) + 1))
    )
    n = F.size(fits)
    return F.struct(
        F.when(n == 1, fits[0]).alias("year"),
        F.when(first.isNull() | last.isNull(), "no period to place the year by").when(n == 0, "the year fits no reading near the period").when(n > 1, "the year can be read in two ways").alias("note"),
    )


def day_month(c: Column, first: Column, last: Column) -> Column:
    """'01 Sep' -> the one date within 31 days of the period, else NULL."""
    pattern = r"(?i)^(\d{1,2}) ([a-z]{3})\z"
    month = F.create_map(*[F.lit(x) for m in list(MONTHS)[:12] for x in (m, MONTHS[m])])[F.lower(F.regexp_extract(c, pattern, 2))]
    years = F.array_distinct(F.array(F.year(first), F.year(last)))
    fits = F.filter(F.transform(years, lambda y: real_date(y, month, part(c, pattern, 1))), lambda d: d.between(F.date_add(first, -31), F.date_add(last, 31)))
    return F.when(F.size(fits) == 1, fits[0])


def passbook_date(c: Column) -> Column:
    """dd/mm/yy of a passbook, whose years are always Buddhist: '25/05/68' -> 2025-05-25."""
    p = r"^(\d{2})/(\d{2})/(\d{2})\z"
    return real_date(part(c, p, 3) + 2500 - BUDDHIST, part(c, p, 2), part(c, p, 1))


def excel_serial(d: Column) -> Column:
    return F.datediff(d, F.lit(SPREADSHEET_EPOCH).cast("date"))


def from_serial(n: Column) -> Column:
    return F.date_add(F.lit(SPREADSHEET_EPOCH).cast("date"), F.floor(n).cast("int"))


def date_cell(c: Column, today: str) -> Column:
    """A cell's text -> struct(date, note, kind, day_over_12, either_way).

    Day first; a date that only makes sense month first is read so and noted; a date before 2000
    or beyond next year is noted as unlikely.  ``today`` is given, never the clock.
    """

    def read(t: Column) -> Column:
        serial = t.try_cast("double")
        is_serial = t.rlike(r"^\d+(?:\.\d+)?\z") & (serial > 20000) & (serial < 80000)
        iso, dmy, named = t.rlike(YEAR_MONTH_DAY), t.rlike(DAY_MONTH_YEAR), t.rlike(NAMED_MONTH)
        name = F.lower(F.regexp_extract(t, NAMED_MONTH, 2))
        months = F.create_map(*[F.lit(x) for m, i in MONTHS.items() for x in (m, i)])
        month = lambda n: F.coalesce(F.try_element_at(months, n), F.try_element_at(months, F.concat(n, F.lit("."))))
        figures = F.struct(*[part(t, DAY_MONTH_YEAR, k).alias(n) for k, n in enumerate("aby", 1)])
        both = lambda f: let(full_year(f["y"]), lambda y: F.struct(real_date(y, f["b"], f["a"]).alias("by_day"), real_date(y, f["a"], f["b"]).alias("by_month")))
        found = F.struct(is_serial.alias("serial"), iso.alias("iso"), dmy.alias("dmy"), F.when(dmy, let(figures, both)).alias("days"))

        def value(f: Column) -> Column:
            read_ = (
                F.when(f["serial"], from_serial(serial))
                .when(f["iso"], real_date(full_year(part(t, YEAR_MONTH_DAY, 1)), part(t, YEAR_MONTH_DAY, 2), part(t, YEAR_MONTH_DAY, 3)))
                .when(f["dmy"], F.coalesce(f["days"]["by_day"], f["days"]["by_month"])).when(named, real_date(full_year(part(t, NAMED_MONTH, 3)), let(name, month), part(t, NAMED_MONTH, 1)))
            )
            shape = F.when(f["serial"], "number").when(f["dmy"] & f["days"]["by_day"].isNotNull(), "text").when(f["dmy"] & f["days"]["by_month"].isNotNull(), "swapped").when(f["iso"] | f["dmy"], "shaped").when(t == "", "blank").otherwise("other")
            return F.struct(read_.alias("date"), shape.alias("shape"))

        return let(let(found, value), told)

    def told(r: Column) -> Column:
        value, shape = r["date"], r["shape"]
        note = (
            F.when(shape == "blank", F.lit(None).cast("string")).when(shape == "swapped", "only makes sense month first")
            .when(value.isNull() & (shape == "shaped"), "not a real date").when(value.isNull(), "could not be read as a date")
            .when((F.year(value) < 2000) | (F.year(value) > int(today[:4]) + 1), "an unlikely year")
        )
        ordered, d, m = shape.isin("number", "text"), F.day(value), F.month(value)
        return F.struct(
            value.alias("date"), note.alias("note"), F.when(ordered, shape).alias("kind"), (ordered & (d > 12)).alias("day_over_12"), (ordered & (d <= 12) & (m <= 12) & (d != m)).alias("either_way")
        )

    # Most cells are empty or ISO dates of Western years: those are read without the other patterns.
    iso = F.when(c.rlike(WESTERN_ISO), F.try_to_date(c, "yyyy-MM-dd"))
    made = lambda value, note: F.struct(value.alias("date"), note.alias("note"), none.alias("kind"), F.lit(False).alias("day_over_12"), F.lit(False).alias("either_way"))
    none = F.lit(None).cast("string")
    unlikely = F.when((F.year(iso) < 2000) | (F.year(iso) > int(today[:4]) + 1), "an unlikely year")
    return F.when(F.coalesce(c == "", F.lit(True)), made(F.lit(None).cast("date"), none)).when(iso.isNotNull(), made(iso, unlikely)).otherwise(_let_read(c, read))


def _let_read(c: Column, read) -> Column:
    return let(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\A(?U:\s)+|(?U:\s)+\z", ""), r"(?U)\s+", " "), read)


def month_of(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def printed(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


#: How many years before today a period with two-digit years may lie (and one after it); a numeric date,
#: a date with a month's name, and a whole month, as periods print them.
PERIOD_YEARS_BACK = 20
NUMERIC_DATE = r"\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})\b"
SPELLED_DATE = r"\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w* \d{4}"
WHOLE_MONTH = r"(?<![\d/])\d{1,2}/\d{4}(?![\d/])"
NAMED_YEAR_MONTH = r"(?i)(?<!\d )\b[a-z]{3} \d{4}\b"


def _short_year(y: Column, now: int) -> Column:
    """A two-digit year as the one Western or Buddhist reading near enough to ``now``; NULL if both or neither are."""
    near = lambda full: full.between(now - PERIOD_YEARS_BACK, now + 1)
    west, east = y + 2000, y + 2500 - BUDDHIST
    return F.when(near(west) & ~near(east), west).when(near(east) & ~near(west), east)


def period_dates(c: Column, today: str) -> Column:
    """Every date of a period's text -> struct(days, refused): numeric dates in order, then those with a month's name.

    Days are structs of year, month and day as printed, but for two-digit years, which are read only where one calendar fits; else
    the whole text is refused.  Without any date, a list of whole months gives the first one's first day and the last one's last.
    """
    now = int(today[:4])
    months = F.create_map(*[F.lit(x) for m in list(MONTHS)[:12] for x in (m, MONTHS[m])])
    all_of = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    day = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    def numeric(t: Column) -> Column:
        p = r"^(\d+)/(\d+)/(\d+)\z"
        year = F.when(F.length(F.regexp_extract(t, p, 3)) == 2, _short_year(part(t, p, 3), now)).otherwise(part(t, p, 3))
        return day(year, part(t, p, 2), part(t, p, 1))

    def spelled(t: Column) -> Column:
        p = r"^(\d+) (\w{3})\w* (\d{4})\z"
        return day(part(t, p, 3), F.try_element_at(months, F.lower(F.regexp_extract(t, p, 2))), part(t, p, 1))

    def ends(found: Column, year, month) -> Column:
        a, b = F.get(found, F.lit(0)), F.try_element_at(found, F.lit(-1))
        last = F.day(F.last_day(real_date(western(year(b)), month(b), F.lit(1))))
        return F.array(day(year(a), month(a), F.lit(1)), day(year(b), month(b), last))

    listed, named = all_of(WHOLE_MONTH), all_of(NAMED_YEAR_MONTH)
    of_list, of_name = lambda t: part(t, r"^(\d+)/", 1), lambda t: F.try_element_at(months, F.lower(F.left(t, F.lit(3))))
    year_of = lambda t: part(t, r"(\d{4})\z", 1)
    dated = F.concat(F.transform(all_of(NUMERIC_DATE), numeric), F.transform(all_of(SPELLED_DATE), spelled))
    whole = (F.size(listed) > 0) & F.forall(listed, lambda t: of_list(t).between(1, 12))
    known = F.forall(named, lambda t: of_name(t).isNotNull()) & (F.size(named) > 0)
    days = F.when(F.size(dated) > 0, dated).when(whole, ends(listed, year_of, of_list)).when(known, ends(named, year_of, of_name)).otherwise(F.slice(dated, 1, 0))
    refused = F.exists(dated, lambda x: x["y"].isNull())
    return F.struct(F.when(~refused, days).alias("days"), refused.alias("refused"))


def period(c: Column, today: str) -> Column:
    """A printed period -> struct(period_from, period_to, refused): its first two dates, both NULL unless both are in the calendar."""

    def bounds(found: Column) -> Column:
        at = lambda i: F.get(found["days"], F.lit(i))
        one = lambda x: real_date(western(x["y"]), x["m"], x["d"])
        a, b = one(at(0)), one(at(1))
        both = a.isNotNull() & b.isNotNull()
        return F.struct(F.when(both, a).alias("period_from"), F.when(both, b).alias("period_to"), found["refused"].alias("refused"))

    return let(period_dates(c, today), bounds)
