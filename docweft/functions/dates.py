"""Date and time verbs: ISO texts, dates or timestamps in, ISO texts out (UTC)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .logic import iso_date
from .values import TransformError, fmt, integer, is_numeric, num, verb

STAMP = "yyyy-MM-dd'T'HH:mm:ss"


def day(ctx, c) -> Column:
    return iso_date(ctx, c)


def stamp(ctx, c) -> Column:
    """A timestamp; a text's zone offset is dropped, a date is midnight."""
    t = ctx.type(c)
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    s = c.cast("string")
    plain = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)", 1)
    return F.replace(plain, F.lit("T"), F.lit(" ")).try_cast("timestamp")


def iso(t: Column) -> Column:
    return F.date_format(t, STAMP)


def whole(ctx, n) -> Column:
    n = integer(ctx, n)
    return F.lit(n) if isinstance(n, int) else n


#: Tokens of the patterns, in Spark's spelling.
TOKENS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}


def spark_pattern(form: str, tokens=tuple(TOKENS)) -> str:
    """The tokens in Spark's spelling, all other text quoted."""
    parts = re.split("(" + "|".join(tokens) + ")", form)
    return "".join(TOKENS[p] if k % 2 else f"'{p.replace(chr(39), chr(39) * 2)}'" if p else "" for k, p in enumerate(parts))


@verb("today")
def today(ctx):
    return F.current_date().cast("string")


@verb("now")
def now(ctx):
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


@verb("formatDate")
def format_date(ctx, d, form):
    return F.date_format(day(ctx, d), spark_pattern(str(ctx.value(form)), ("YYYY", "MM", "DD")))


@verb("formatTime")
def format_time(ctx, t, form):
    s = fmt(ctx, t)
    clock = F.concat(F.lit("1970-01-01 "), F.regexp_extract(s, r"(\d{2}:\d{2}(?::\d{2})?)", 1)).try_cast("timestamp")
    return F.date_format(clock, spark_pattern(str(ctx.value(form)), ("HH", "mm", "ss")))


@verb("formatTimestamp")
def format_timestamp(ctx, t, form):
    return F.date_format(stamp(ctx, t), spark_pattern(str(ctx.value(form))))


def _piece(s: Column, form: str, token: str, default: str) -> Column:
    at = form.find(token)
    if at < 0:
        return F.lit(default)
    cut = F.substring(s, at + 1, len(token))
    return F.when(F.rlike(cut, F.lit(rf"^\d{{{len(token)}}}$")), cut).otherwise(F.lit(default))


@verb("parseDate")
def parse_date(ctx, s, form):
    s, form = fmt(ctx, s), str(ctx.value(form))
    return F.concat_ws("-", _piece(s, form, "YYYY", "1970"), _piece(s, form, "MM", "01"), _piece(s, form, "DD", "01"))


@verb("parseTimestamp")
def parse_timestamp(ctx, s, form):
    s, f = fmt(ctx, s), str(ctx.value(form))
    return F.concat(parse_date(ctx, s, form), F.lit("T"), F.concat_ws(":", _piece(s, f, "HH", "00"), _piece(s, f, "mm", "00"), _piece(s, f, "ss", "00")))


# Order of day, month and year by language; others write month first.
LOCALE_DATES = {"en-gb": "d/M/yyyy", "de": "d.M.yyyy", "fr": "d/M/yyyy", "es": "d/M/yyyy", "it": "d/M/yyyy", "nl": "d-M-yyyy", "pt": "d/M/yyyy", "ja": "yyyy/M/d", "zh": "yyyy/M/d", "sv": "yyyy-M-d"}


@verb("formatLocaleDate")
def format_locale_date(ctx, d, locale=None):
    name = str(ctx.value(locale, "en-US") if locale is not None else "en-US").lower().replace("_", "-")
    return F.date_format(day(ctx, d), LOCALE_DATES.get(name) or LOCALE_DATES.get(name[:2], "M/d/yyyy"))


@verb("isValidDate")
def is_valid_date(ctx, s, form):
    f = str(ctx.value(form))
    if f not in ("YYYY-MM-DD", "MM/DD/YYYY", "DD/MM/YYYY", "YYYYMMDD"):
        return F.lit(False)
    return F.coalesce((F.length(fmt(ctx, s)) == len(f)) & F.try_to_date(fmt(ctx, s), spark_pattern(f)).isNotNull(), F.lit(False))


@verb("addDays")
def add_days(ctx, d, n):
    return F.date_add(day(ctx, d), whole(ctx, n)).cast("string")


@verb("addMonths")
def add_months(ctx, d, n):
    return F.add_months(day(ctx, d), whole(ctx, n)).cast("string")


@verb("addYears")
def add_years(ctx, d, n):
    return F.add_months(day(ctx, d), (whole(ctx, n) * 12).cast("int")).cast("string")


def _shift(seconds: int):
    return lambda ctx, t, n: iso(F.timestamp_seconds(F.unix_timestamp(stamp(ctx, t)) + whole(ctx, n).cast("long") * seconds))


verb("addHours")(_shift(3600))
verb("addMinutes")(_shift(60))
verb("addSeconds")(_shift(1))


@verb("dateDiff")
def date_diff(ctx, a, b, unit):
    a, b = day(ctx, a), day(ctx, b)
    name = str(ctx.value(unit, "days")).lower().rstrip("s")
    if name == "day":
        return F.datediff(b, a)
    if name == "month":
        return (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))
    if name == "year":
        return F.year(b) - F.year(a)
    raise TransformError("T011", f"unknown unit {name}")


@verb("daysBetweenDates")
def days_between(ctx, a, b):
    return F.datediff(day(ctx, b), day(ctx, a))


@verb("ageFromDate")
def age(ctx, born, at=None):
    b, r = day(ctx, born), F.current_date() if at is None else day(ctx, at)
    years = F.year(r) - F.year(b) - F.when(F.date_format(r, "MMdd") < F.date_format(b, "MMdd"), 1).otherwise(0)
    return F.greatest(years, F.lit(0))


@verb("startOfDay")
def start_of_day(ctx, d):
    return F.concat(day(ctx, d).cast("string"), F.lit("T00:00:00"))


@verb("endOfDay")
def end_of_day(ctx, d):
    return F.concat(day(ctx, d).cast("string"), F.lit("T23:59:59"))


@verb("startOfMonth")
def start_of_month(ctx, d):
    return F.trunc(day(ctx, d), "month").cast("string")


@verb("endOfMonth")
def end_of_month(ctx, d):
    return F.last_day(day(ctx, d)).cast("string")


@verb("startOfYear")
def start_of_year(ctx, d):
    return F.trunc(day(ctx, d), "year").cast("string")


@verb("endOfYear")
def end_of_year(ctx, d):
    return F.make_date(F.year(day(ctx, d)), F.lit(12), F.lit(31)).cast("string")


@verb("dayOfWeek")
def day_of_week(ctx, d):
    return F.weekday(day(ctx, d)) + 1


@verb("weekOfYear")
def week_of_year(ctx, d):
    return F.weekofyear(day(ctx, d))


@verb("quarter")
def quarter(ctx, d):
    return F.quarter(day(ctx, d))


@verb("isLeapYear")
def is_leap_year(ctx, d):
    y = num(ctx, d).cast("int") if is_numeric(ctx.type(d)) else F.year(day(ctx, d))
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


@verb("isBefore")
def is_before(ctx, a, b):
    return fmt(ctx, a) < fmt(ctx, b)


@verb("isAfter")
def is_after(ctx, a, b):
    return fmt(ctx, a) > fmt(ctx, b)


@verb("isBetween")
def is_between(ctx, d, low, high):
    return fmt(ctx, d).between(fmt(ctx, low), fmt(ctx, high))


@verb("toUnix")
def to_unix(ctx, t):
    return F.unix_timestamp(stamp(ctx, t))


@verb("fromUnix")
def from_unix(ctx, n):
    return iso(F.timestamp_seconds(F.floor(num(ctx, n))))


@verb("businessDays")
def business_days(ctx, d, n):
    """n weekdays on (or back): whole weeks by sevens, the rest stepped over the weekend."""
    start, steps = day(ctx, d), whole(ctx, n).cast("int")
    weekend = F.weekday(start) >= 5
    forward = steps >= 0
    anchored = F.when(weekend & forward, F.date_sub(start, F.weekday(start) - 4)).when(weekend, F.date_add(start, 7 - F.weekday(start))).otherwise(start)
    size = F.abs(steps)
    weeks, rest = F.floor(size / 5).cast("int"), (size % 5).cast("int")
    wd = F.weekday(anchored)
    moved = F.when(forward, weeks * 7 + rest + F.when(wd + rest > 4, 2).otherwise(0)).otherwise(-(weeks * 7 + rest + F.when(wd - rest < 0, 2).otherwise(0)))
    return F.when(steps == 0, start).otherwise(F.date_add(anchored, moved.cast("int"))).cast("string")


@verb("nextBusinessDay")
def next_business_day(ctx, d):
    x = day(ctx, d)
    return F.date_add(x, F.when(F.weekday(x) == 4, 3).when(F.weekday(x) == 5, 2).otherwise(1)).cast("string")


@verb("formatDuration")
def format_duration(ctx, v):
    """`1 day, 2 hours, 3 minutes, 4 seconds` from seconds or an ISO duration of days and less."""
    if is_numeric(ctx.type(v)):
        seconds = F.floor(F.abs(num(ctx, v))).cast("long")
    else:
        s = fmt(ctx, v)
        part = lambda form: F.coalesce(F.nullif(F.regexp_extract(s, form, 1), F.lit("")).cast("long"), F.lit(0))
        seconds = part(r"(\d+)W") * 604800 + part(r"(\d+)D") * 86400 + part(r"T.*?(\d+)H") * 3600 + part(r"T.*?(\d+)M") * 60 + part(r"T.*?(\d+)(?:\.\d+)?S")
    units = [("day", F.floor(seconds / 86400)), ("hour", F.floor(seconds % 86400 / 3600)), ("minute", F.floor(seconds % 3600 / 60)), ("second", seconds % 60)]
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))) for name, n in units]
    return F.when(seconds == 0, "0 seconds").otherwise(F.concat_ws(", ", *parts))
