"""Free-form feed dates against the public dateutil parser, which the rule being reproduced is."""
import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from eventlens import fixed_values as fx
from eventlens.functions import dates

parser = pytest.importorskip("dateutil.parser")

FORMS = [
    "Tue, 02 Dec 2025 10:30:00 +0000", "2 Dec 2025 10:30", "2 December 2025", "December 2, 2025", "Dec 2 2025 10:30 PM", "Dec. 2, 2025 at 10:30",
    "Tuesday, December 2, 2025 10:30 AM", "2nd December 2025", "the 2 Dec 2025", "Dec 2nd, 2025 5pm", "2025 Dec 2", "2025-12-02 10:30:15.250",
    "2025/12/02", "2025/12/2 7:05", "2025.12.02 10:30", "12/02/2025", "12/25/2025 10:30", "25/12/2025", "25/12/2025 10:30:59", "25-11-2025 12:18",
    "12-25-2025", "1/2/2025", "13.1.2025", "12:18 25-11-2025", "10:30 Dec 2, 2025", "10:30:45 2 Dec 2025", "5:07 pm 2 Dec 2025", "12 am Dec 2 2025",
    "12:30 AM 2 Dec 2025", "12:30 PM 2 Dec 2025", "2 Dec 25", "Dec 2, 99", "2 Jan 70", "12/02/25", "25/12/24 10:00", "20251202", "20251202T103045",
    "20251202103045", "2025-12-02T10:30:00Z", "2025-12-02T10:30:00-05:00", "2 Dec 2025 10:30 GMT", "2 Dec 2025 10:30:00 UTC", "Dec 2 2025 10:30 +0530",
    "2 Dec 2025 23:30 -0800", "Sat, 29 Feb 2020 00:00:00 GMT", "Thu Dec 04 10:30:00 2025", "04 Dec 2025 10:30:00.5 +0200", "Dec/02/2025", "2-Dec-2025",
    "02-DEC-2025 10:30", "Sept 5, 2025", "5 sep 2025", "9 June 2025 8 a.m.", "MAY 5 2025", "2025 12 02", "on 2 Dec 2025 at 9:05",
]
BAD = ["12:18 | 25-11-2025", "", "   ", "yesterday", "32 Dec 2025", "2025-13-45", "31/31/2025", "29 Feb 2021", "Dec 2 2025 25:00", "13:00 pm 2 Dec 2025", "word 2 Dec 2025",
       "2 Dec 2025 10:30 | x", None]


def _want(text):
    try:
        got = parser.parse(text, default=dt.datetime(2001, 1, 1))
    except (parser.ParserError, OverflowError):
        return "N/A"
    if got.tzinfo is not None:
        got = got.astimezone(ZoneInfo(fx.APP_TIMEZONE))
    return got.strftime("%Y-%m-%d %H:%M:%S")


def test_forms_equal_the_public_parser(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(FORMS)], "k int, t string")
    got = {r.t: r.out for r in df.select("t", dates.standardize_feed_date(F.col("t")).alias("out")).collect()}
    wrong = {t: (got[t], _want(t)) for t in FORMS if got[t] != _want(t)}
    assert not wrong, wrong


def test_what_does_not_parse(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(BAD)], "k int, t string")
    got = [(r.t, r.out) for r in df.select("t", dates.standardize_feed_date(F.col("t")).alias("out")).collect()]
    assert all(out == "N/A" for _, out in got), got
