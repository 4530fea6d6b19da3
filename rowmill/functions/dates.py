"""Parts of dates and the shapes of date, time and phone text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Date shapes, tested in this order.
DATE_SHAPES = [
    (r"^\d{4}-\d{2}-\d{2}$", "YYYY-MM-DD"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/DD/YYYY"),
    (r"^\d{2}-\d{2}-\d{4}$", "DD-MM-YYYY"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "DD.MM.YYYY"),
]

# Phone shapes, tested in this order.
PHONE_SHAPES = [
    (r"^\d{3}-\d{3}-\d{4}$", "XXX-XXX-XXXX"),
    (r"^\(\d{3}\)\s*\d{3}-\d{4}$", "(XXX) XXX-XXXX"),
    (r"^\+\d{1,3}\s*\d{3}\s*\d{3}\s*\d{4}$", "+X XXX XXX XXXX"),
]

# Fixed value: three letters of each month, in order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "microsecond": lambda t: (F.unix_micros(t) % 1_000_000).cast("int"),
    "quarter": F.quarter,
    "dayofweek": F.weekday,
    "day_of_week": F.weekday,
    "dayofyear": F.dayofyear,
    "day_of_year": F.dayofyear,
    "week": F.weekofyear,
    "weekofyear": F.weekofyear,
    "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
    "daysinmonth": lambda t: F.dayofmonth(F.last_day(t)),
    "is_leap_year": lambda t: F.dayofyear(F.last_day(F.trunc(F.add_months(F.trunc(t, "year"), 11), "month"))) == 366,
    "is_month_start": lambda t: F.dayofmonth(t) == 1,
    "is_month_end": lambda t: F.to_date(t) == F.last_day(t),
    "is_quarter_start": lambda t: F.to_date(t) == F.trunc(t, "quarter"),
    "is_quarter_end": lambda t: F.to_date(t) == F.date_sub(F.add_months(F.trunc(t, "quarter"), 3), 1),
    "is_year_start": lambda t: F.dayofyear(t) == 1,
    "is_year_end": lambda t: (F.month(t) == 12) & (F.dayofmonth(t) == 31),
}


def moment(c: Column) -> Column:
    """The time a text writes: ISO, or year, month and day by other signs, digits only, or with the month's name; else null.

    Of two numbers before the year the first is the month, unless it is over 12.
    """
    clock = r"(?:[ T]+(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?))?\s*$"
    numbers = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})" + clock
    by_year = r"^\s*(\d{4})[/.-]?(\d{2})[/.-]?(\d{2})" + clock
    named = r"(?i)^\s*(?:[a-z]{3,9}day,?\s+)?(?:(\d{1,2})(?:st|nd|rd|th)?[ -]+)?([a-z]{3})[a-z]*\.?[ -]+(?:(\d{1,2})(?:st|nd|rd|th)?,?\s+)?(\d{4})" + clock
    part = lambda pattern, k: F.regexp_extract(c, pattern, k)

    def made(pattern: str, year: Column, month: Column, day: Column, time: int) -> Column:
        text = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), part(pattern, time))
        return F.when(c.rlike(pattern), F.try_to_timestamp(F.btrim(text)))

    first, second = part(numbers, 1), part(numbers, 2)
    swap = first.try_cast("int") > 12
    place = F.instr(F.lit(MONTHS), F.lower(part(named, 2)))
    month = F.floor((place + 2) / 3).cast("string")
    day = F.concat(part(named, 1), part(named, 3))  # one of them is empty, else the text is no date
    return F.coalesce(
        F.try_to_timestamp(c), made(numbers, part(numbers, 3), F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second), 4),
        made(by_year, part(by_year, 1), part(by_year, 2), part(by_year, 3), 4),
        F.when(place % 3 == 1, made(named, part(named, 4), month, F.when(day == "", "1").otherwise(day), 5)))


def date_part(c: Column, kind: str, part: str) -> Column:
    """One part of a date or of a text that writes one (Monday is day 0 of the week); an unknown part is null."""
    if part not in _PARTS:
        return F.lit(None).cast("int")
    return _PARTS[part](moment(c) if kind == "string" else c.cast("timestamp"))


def shape_of(c: Column, kind: str = "date") -> Column:
    """Name of the first shape the whole text has, ``unknown`` for others, null for null and ''."""
    shapes = DATE_SHAPES if kind == "date" else PHONE_SHAPES
    text = c.cast("string")
    named = F.lit("unknown")
    for pattern, name in reversed(shapes):
        named = F.when(text.rlike(pattern), name).otherwise(named)
    return F.when(text.isNotNull() & (text != ""), named)


def standard_date(c: Column) -> Column:
    """The four date shapes as YYYY-MM-DD; text of no shape, or no calendar date, stays as it is."""
    formats = ["yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy"]
    found = F.lit(None).cast("string")
    for (pattern, _), layout in reversed(list(zip(DATE_SHAPES, formats))):
        parsed = F.date_format(F.try_to_timestamp(c, F.lit(layout)), "yyyy-MM-dd")
        found = F.when(c.rlike(pattern), parsed).otherwise(found)
    return F.coalesce(found, c)
