"""Date and time expressions: ISO week, Spanish weekday, month period, hour parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillsight.config import DAY_ORDER


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_year_week(d: Column | str) -> Column:
    """ISO 8601 ``YYYY-Www`` (ISO year, zero-padded ISO week)."""
    d = _c(d)
    return F.concat(
        F.date_part(F.lit("YEAROFWEEK"), d).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
    )


def year_month(d: Column | str) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def weekday_ix(d: Column | str) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(_c(d))


def weekday_es(d: Column | str) -> Column:
    """Spanish weekday abbreviation of a date (``Lun`` … ``Dom``)."""
    return F.element_at(F.array(*[F.lit(x) for x in DAY_ORDER]), F.weekday(_c(d)) + 1)


def month_abbr(d: Column | str) -> Column:
    return F.date_format(_c(d), "MMM")


def days_in_month(d: Column | str) -> Column:
    return F.dayofmonth(F.last_day(_c(d)))


_EXPORT_TIME = "^(?:0?[1-9]|1[0-2]):[0-5]\\d:[0-5]\\d [AP]M$"  # told by its digits, without a formatter


def parse_hour(t: Column | str) -> Column:
    """Hour of a POS time text.

    Accepts ``h:mm:ss AM/PM`` (the export format) and 24-hour ``H:mm[:ss]``; a missing
    time gives hour 0 (a synthesised ``00:00`` must not discard every row), an unparsable
    one gives null.
    """
    t = F.trim(_c(t))
    ts = F.coalesce(
        F.try_to_timestamp(t, F.lit("h:mm:ss a")),
        F.try_to_timestamp(t, F.lit("h:mm a")),
        F.try_to_timestamp(t, F.lit("H:mm:ss")),
        F.try_to_timestamp(t, F.lit("H:mm")),
    )
    hour12 = F.substring_index(t, ":", 1).try_cast("int") % 12
    return (F.when(t.isNull() | (t == ""), F.lit(0))
            .when(t.rlike(_EXPORT_TIME), F.when(t.endswith("PM"), hour12 + 12).otherwise(hour12))
            .otherwise(F.hour(ts)))


_CLOCK = "(?:[T ]\\s*\\d{1,2}:\\d{2}(?::\\d{2}(?:\\.\\d+)?)?(?:\\s*[AaPp]\\.?[Mm]\\.?)?(?:Z|[+-]\\d{2}:?\\d{2})?)?$"
_YEAR_FIRST = "^(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})" + _CLOCK
_PLAIN = "^\\d{4}-\\d{2}-\\d{2}$"  # what a cast reads as it is
_YEAR_LAST = "^(\\d{1,2})[-/.](\\d{1,2})[-/.](\\d{4})" + _CLOCK


def parse_date(c: Column | str, day_first: bool = False) -> Column:
    """Text date → DATE; bad value → null.

    Year first (``2026-3-5``, ``2026/03/05``, with or without a time) or year last.  In
    year-last dates the month leads, as in the reference data, unless ``day_first``; a leading
    number that can't be what it should be (``31/12/2026``) is read the other way round.
    """
    c = F.trim(_c(c))

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(c, pattern, k)

    def made(year: Column, month: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    first, second, year = (part(_YEAR_LAST, k) for k in (1, 2, 3))
    month_led, day_led = made(year, first, second), made(year, second, first)
    last = F.coalesce(day_led, month_led) if day_first else F.coalesce(month_led, day_led)
    return F.when(c.rlike(_PLAIN), c.try_cast("date")).when(c.rlike(_YEAR_FIRST), made(*(part(_YEAR_FIRST, k) for k in (1, 2, 3)))).when(c.rlike(_YEAR_LAST), last)
