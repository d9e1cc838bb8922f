"""Date and time expressions (E-7 … E-13, E-21).

Timestamps stay TIMESTAMP_NTZ (wall clock of the application zone) so that
the session time zone never leaks into results.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fx

STORE_FMT = "yyyy-MM-dd HH:mm:ss"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ntz(c, fmt: str = STORE_FMT) -> Column:
    """E-9: strict parse to a wall-clock timestamp; null when it does not parse."""
    return F.try_to_timestamp(_c(c), F.lit(fmt)).cast("timestamp_ntz")


def _wall(instant: Column, app_tz: str = fx.APP_TIMEZONE) -> Column:
    """An instant (TIMESTAMP) as wall clock of ``app_tz``, whatever the session's zone."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    zero = F.lit(0)
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(app_tz), utc)


def parse_iso(c, app_tz: str = fx.APP_TIMEZONE) -> Column:
    """E-10: ISO-8601 text ('T' or ' ' separator, optional fraction and zone) as wall clock of
    ``app_tz``; null on failure.  Zoned input is converted, input without a zone is that clock."""
    x = F.regexp_replace(_c(c), r"(?<=[T ])([0-9]{2}:[0-9]{2})(?=$|[ Z+-])", "$1:00")
    x = F.regexp_replace(x, r"(:[0-9]{2}(?:\.[0-9]+)?) ?(?:Z|UTC|GMT)$", "$1+00:00")
    x = F.regexp_replace(x, r"(:[0-9]{2}(?:\.[0-9]+)?) ?([+-][0-9]{2})(?::?([0-9]{2}))$", "$1$2:$3")
    zoned = x.rlike(r":[0-9]{2}(?:\.[0-9]+)?[+-][0-9]{2}(?::[0-9]{2})?$")
    return F.when(zoned, _wall(x.try_cast("timestamp"), app_tz)).otherwise(x.try_cast("timestamp_ntz"))


# Formats tried, in order, after a leading weekday name is removed; ISO-8601 forms go by ``parse_iso``.
ZONED_FORMATS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z"]
NAIVE_FORMATS = [
    "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "d MMMM yyyy HH:mm:ss", "d MMMM yyyy HH:mm", "d MMMM yyyy",
    "MMM d, yyyy h:mm:ss a", "MMM d, yyyy h:mm a", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy HH:mm", "MMM d, yyyy",
    "MMMM d, yyyy h:mm:ss a", "MMMM d, yyyy h:mm a", "MMMM d, yyyy HH:mm:ss", "MMMM d, yyyy HH:mm", "MMMM d, yyyy",
]


#: The free-form parser's words.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_RE = (r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b")
WEEKDAY_RE = r"\b(?:mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b"
CLOCK_RE = r"(?:^|(?<=[ t,]))([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]{1,9})?)? ?((?:am|pm)\b)?(?: ?(z|utc|gmt)\b| ?([+-][0-9]{2}):?([0-9]{2})(?![0-9]))?"
JUMP_RE = r"[ ,.;/'-]|\b(?:at|on|and|of|ad|t|m)\b"


def parse_free_date(c, app_tz: str = fx.APP_TIMEZONE) -> Column:
    """E-7 for texts in no listed format: the classes of the tokens decide, in whatever order they come.

    A clock time (with am or pm, and a zone), a month's name, a weekday, numbers and separators are told apart; any
    other token makes the text unparseable.  With a month's name two numbers are day and year, without one three
    numbers are year-month-day if the first is no day, else month-day-year, or day-month-year if the first is no month.
    A year of two digits is the one within fifty years of today.  A text without a day, a month or a
    year is null: it would have to be filled from today's date."""
    x = F.lower(F.trim(_c(c)))
    x = F.regexp_replace(x, r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:[t ]?([0-9]{2})([0-9]{2})([0-9]{2}))?$", "$1-$2-$3 0$4:0$5:0$6")
    x = F.regexp_replace(x, r" 0?([0-9]{0,2}):0?([0-9]{0,2}):0?([0-9]{0,2})$", " $1:$2:$3")
    x = F.regexp_replace(x, r" ::$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\b([ap])\.m\.", "$1m"), r"(?<=[0-9])(st|nd|rd|th)\b", "")
    x = F.regexp_replace(x, r"\b([0-9]{1,2}) ?(am|pm)\b", "$1:00 $2")
    x = F.regexp_replace(x, r":([0-9]{2}):00 (am|pm)\b", ":$1 $2")
    x = F.regexp_replace(x, r"(?<=[0-9])t(?=[0-9]{1,2}:)", " t")
    clock = lambda k: F.regexp_extract(x, CLOCK_RE, k)
    number = lambda text: F.when(text != "", text.cast("int"))
    hour, half = number(clock(1)), clock(4)
    hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    rest = F.regexp_replace(F.regexp_replace(x, CLOCK_RE, " "), WEEKDAY_RE, " ")
    name = F.regexp_extract(rest, MONTH_RE, 1)
    before = F.size(F.regexp_extract_all(F.call_function("substring_index", rest, name, F.lit(1)), F.lit("[0-9]+"), F.lit(0)))  # numbers before the month
    digits = F.regexp_extract_all(rest, F.lit("[0-9]+"), F.lit(0))
    left = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, MONTH_RE, " "), "[0-9]+", ""), JUMP_RE, "")
    n = F.transform(digits, lambda d: F.when(F.length(d) <= 4, d.cast("int")))
    a, b, d3 = (F.get(n, F.lit(k)) for k in range(3))
    whole = lambda k: F.length(F.get(digits, F.lit(k))) > 2  # noqa: E731  a year with its century
    named, three = (name != "") & (F.size(n) == 2), (name == "") & (F.size(n) == 3)
    first_is_year = whole(0) | (a > 31) | ((before == 2) & ~whole(1) & (b <= 31))
    year_first = whole(0) | (a > 31)
    year = F.when(named, F.when(first_is_year, a).otherwise(b)).when(three, F.when(year_first, a).otherwise(d3))
    century = F.when(named, F.when(first_is_year, whole(0)).otherwise(whole(1))).when(three, F.when(year_first, whole(0)).otherwise(whole(2)))
    day = F.when(named, F.when(first_is_year, b).otherwise(a)).when(three, F.when(year_first, d3).when(a > 12, a).otherwise(b))
    month = F.when(named, F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(name, 1, 3)).cast("int")).when(
        three, F.when(year_first, b).when(a > 12, b).otherwise(a))
    now = F.year(F.current_date())
    near = F.when(year + 2000 >= now + 50, year + 1900).otherwise(year + 2000)
    year = F.when(century, year).otherwise(near)
    zero = F.lit(0)
    wall = F.try_make_timestamp_ntz(year, month, day, F.coalesce(hour, F.when(clock(1) == "", zero)), F.coalesce(number(clock(2)), zero),
                                    F.coalesce(number(clock(3)), zero).cast("decimal(8,6)"))
    sign = F.when(F.substring(clock(6), 1, 1) == "-", -1).otherwise(1)
    shift = sign * (F.abs(number(clock(6))) * 60 + number(clock(7)))
    utc = F.when(clock(5) != "", wall).when(clock(6) != "", F.timestamp_add("MINUTE", -shift, wall))
    local = F.coalesce(F.convert_timezone(F.lit("UTC"), F.lit(app_tz), utc), wall)
    return F.when((left == "") & (named | three), local)


def parse_feed_date(c, app_tz: str = fx.APP_TIMEZONE) -> Column:
    """E-8 parse-or-null: a feed date as wall clock of ``app_tz`` (NTZ).

    Zoned inputs are instants and are converted; inputs without a zone are taken as
    application wall clock, as the reference does."""
    raw = F.regexp_replace(F.trim(_c(c)), r"^[A-Za-z]{3,9},\s*", "")
    zoned = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in ZONED_FORMATS])
    naive = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in NAIVE_FORMATS]).cast("timestamp_ntz")
    listed = F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), parse_iso(raw, app_tz)) \
        .otherwise(F.coalesce(_wall(zoned, app_tz), naive))
    return F.coalesce(listed, parse_free_date(c, app_tz))


def standardize_feed_date(c, app_tz: str = fx.APP_TIMEZONE) -> Column:
    """E-7: free-form feed date -> 'yyyy-MM-dd HH:mm:ss' in the application zone, else 'N/A'."""
    return F.coalesce(F.date_format(parse_feed_date(c, app_tz), STORE_FMT), F.lit("N/A"))


def seconds_between(start, end) -> Column:
    """Whole seconds from ``start`` to ``end`` (truncated toward zero)."""
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def time_ago(ts, as_of) -> Column:
    """E-11: Arabic relative time, server variant.  ``ts`` and ``as_of`` are NTZ."""
    s = seconds_between(ts, as_of)
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    return (
        F.when(s.isNull(), F.lit(None))
        .when(s < 60, F.lit(fx.AGO_NOW))
        .when(s < 3600, F.when(m == 1, F.lit(fx.AGO_MINUTE_1)).when(m == 2, F.lit(fx.AGO_MINUTE_2))
              .otherwise(F.format_string(fx.AGO_MINUTES.replace("{}", "%d"), m)))
        .when(s < 86400, F.when(h == 1, F.lit(fx.AGO_HOUR_1)).when(h == 2, F.lit(fx.AGO_HOUR_2))
              .otherwise(F.format_string(fx.AGO_HOURS.replace("{}", "%d"), h)))
        .when(s < 2592000, F.when(d == 1, F.lit(fx.AGO_DAY_1)).when(d == 2, F.lit(fx.AGO_DAY_2))
              .otherwise(F.format_string(fx.AGO_DAYS.replace("{}", "%d"), d)))
        .otherwise(F.date_format(_c(ts), "yyyy-MM-dd"))
    )


def time_ago_text(text, as_of) -> Column:
    """E-11 over stored text: unparseable input is returned unchanged."""
    ts = parse_iso(text)
    return F.coalesce(time_ago(ts, as_of), _c(text))


def time_ago_client(ts, as_of) -> Column:
    """E-12: client variant (years … minutes, floor, strictly more than one unit)."""
    us = F.timestamp_diff("MICROSECOND", _c(ts), _c(as_of))
    s = F.floor(us / 1_000_000)
    out = F.lit(fx.CLIENT_AGO_NOW)
    for unit, label in reversed(fx.CLIENT_AGO_UNITS):
        out = F.when(s / unit > 1, F.concat(F.lit(fx.CLIENT_AGO_PREFIX), F.floor(s / unit).cast("string"),
                                             F.lit(" " + label))).otherwise(out)
    return F.when(_c(ts).isNull(), F.lit("")).otherwise(out)


def date_display(text) -> Column:
    """E-13: 'yyyy-MM-dd HH:mm' of an ISO text; unchanged when it does not parse."""
    return F.coalesce(F.date_format(parse_iso(text), "yyyy-MM-dd HH:mm"), _c(text))


def iso_text(ts) -> Column:
    """Python ``datetime.isoformat()`` of an NTZ value (fraction only when non-zero)."""
    base = F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(_c(ts), "SSSSSS")
    return F.when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))


def page_numbers(page, total, per_page) -> Column:
    """E-21: pages shown around ``page`` (page-2 … page+2, clipped to 1 … total_pages)."""
    pages = F.floor((_c(total) + _c(per_page) - 1) / _c(per_page))
    start = F.greatest(F.lit(1), _c(page) - 2)
    end = F.least(pages + 1, _c(page) + 3)
    return F.when(end - 1 >= start, F.sequence(start.cast("long"), (end - 1).cast("long"))) \
        .otherwise(F.array().cast("array<bigint>"))


# ---------------------------------------------------------------------------
# E-8 zone operations (NTZ values are application-zone wall clock)
# ---------------------------------------------------------------------------
def to_app_zone(ts, app_tz: str = fx.APP_TIMEZONE, naive_is_app: bool = True) -> Column:
    """E-8 to_app_timezone: an instant (TIMESTAMP) → app wall clock; an NTZ value is
    already app wall clock and is returned unchanged (``naive_is_app=False``: it is UTC)."""
    c = _c(ts)
    naive = c.cast("timestamp_ntz")
    if not naive_is_app:
        naive = F.convert_timezone(F.lit("UTC"), F.lit(app_tz), naive)
    return F.when(F.typeof(c) == "timestamp_ntz", naive).otherwise(_wall(c.cast("timestamp"), app_tz))


def app_to_utc(ntz, app_tz: str = fx.APP_TIMEZONE) -> Column:
    """E-8 to_utc: app wall clock (NTZ) → UTC wall clock (NTZ)."""
    return F.convert_timezone(F.lit(app_tz), F.lit("UTC"), _c(ntz))


def format_ts(ts, fmt: str = STORE_FMT) -> Column:
    """E-8 format_datetime."""
    return F.date_format(_c(ts), fmt)


def app_now(app_tz: str = fx.APP_TIMEZONE) -> Column:
    """E-8 now(): the current instant as app wall clock (use a fixed ``as_of`` in jobs)."""
    return _wall(F.current_timestamp(), app_tz)
