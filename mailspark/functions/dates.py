"""Header dates to zone-free UTC timestamps."""

from email.utils import parsedate_to_datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

# Date layouts met in mail headers, each with the shape it fits.
# The shape is tested first, because a failed timestamp parse costs an exception.
ZONED_LAYOUTS = {
    "d MMM yyyy HH:mm:ss Z": r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$",
    "d MMM yyyy HH:mm Z": r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d [+-]\d{4}$",
}
NAMED_UTC = r"\s+(?:GMT|UTC|UT|Z)$"


@F.pandas_udf(TimestampNTZType())
def _lenient_date(texts: pd.Series) -> pd.Series:
    def parse(text):
        try:
            moment = parsedate_to_datetime(text)
            if moment.tzinfo is not None:
                moment = (moment - moment.utcoffset()).replace(tzinfo=None)
            return np.datetime64(moment, "us")
        except (TypeError, ValueError, OverflowError):
            return np.datetime64("NaT", "us")

    # microseconds hold all years that a header can name, nanoseconds don't
    distinct = {text: parse(text) for text in texts.dropna().unique()}
    moments = [distinct.get(text, np.datetime64("NaT", "us")) for text in texts]
    return pd.Series(np.array(moments, "datetime64[us]"), index=texts.index)


# Names of months by their first three letters, at a place that tells the number.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
WEEKDAY = r"(?i)^\s*(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"
CLOCK = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,6})\d*)?)?(?: ?([AaPp])\.?[Mm]\.?)?"
ZONE = r"(?: ?(Z|[+-]\d\d:?\d\d))?"
MONTH_NAME = r"([A-Za-z]{3,9})\.?"
#: Shapes of dates, and which groups hold year, month, day, the clock (its first group) and the zone. Of a
#: number pair before a year the order is decided by value and separator.
SHAPES = {
    "year_first": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T ]{CLOCK}{ZONE})?$", 1, 2, 3, 4, 9),
    "packed": (rf"^(\d{{4}})(\d\d)(\d\d)(?:[T ]{CLOCK}{ZONE})?$", 1, 2, 3, 4, 9),
    "year_last": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})[-/.](\d{{4}}|\d\d)(?:,? {CLOCK}{ZONE})?$", 4, None, None, 5, 10),
    "day_name": (rf"^(\d{{1,2}})(?:st|nd|rd|th)?[- ]{MONTH_NAME},?[- ](\d{{4}}|\d\d)(?:,? {CLOCK}{ZONE})?$", 3, 2, 1, 4, 9),
    "name_day": (rf"^{MONTH_NAME} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? {CLOCK}{ZONE})?$", 3, 1, 2, 4, 9),
    "clock_before_year": (rf"^{MONTH_NAME} (\d{{1,2}}) {CLOCK}{ZONE} (\d{{4}})$", 9, 1, 2, 3, 8),
}


def _free_form(column):
    """Zone-free UTC timestamp of a date in one of the shapes; NULL for others and for values out of range."""
    text = F.regexp_replace(F.trim(F.regexp_replace(column, r"\s*\([^)]*\)\s*$", "")), r"\s+", " ")
    text = F.regexp_replace(F.regexp_replace(text, WEEKDAY, ""), r"(?i) ?(?:GMT|UTC|UT)$", " +0000")
    # bound once: as a plain expression it would be worked out anew for every field of every shape
    return F.element_at(F.transform(F.array(text), _shaped), 1)


def _shaped(text):
    found = []
    for name, (shape, year_at, month_at, day_at, clock_at, zone_at) in SHAPES.items():

        def part(group, shape=shape):
            return F.nullif(F.regexp_extract(text, shape, group), F.lit(""))

        def number(group, part=part):
            return part(group).cast("int")

        year = number(year_at)
        short = F.length(part(year_at)) == 2
        year = F.when(short, year + F.when(year < 69, 2000).otherwise(1900)).otherwise(year)
        if name == "year_last":
            # month first, but day first after a number above 12 or with dots
            first, second = number(1), number(3)
            day_first = (first > 12) | ((part(2) == ".") & (second <= 12))
            month, day = F.when(day_first, second).otherwise(first), F.when(day_first, first).otherwise(second)
        elif month_at == 2 and name != "day_name":
            month, day = number(month_at), number(day_at)
        else:
            at = F.instr(F.lit(MONTHS), F.lower(F.substring(part(month_at), 1, 3)))
            month, day = F.when(at % 3 == 1, F.floor(at / 3).cast("int") + 1), number(day_at)
        half = F.lower(part(clock_at + 4))
        hour = F.coalesce(number(clock_at), F.lit(0))
        hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        fraction = F.coalesce(F.rpad(part(clock_at + 3), 6, "0").cast("int"), F.lit(0))
        second = F.coalesce(number(clock_at + 2), F.lit(0)).cast("decimal(16,6)") + (fraction / 1_000_000).cast("decimal(16,6)")
        moment = F.try_make_timestamp_ntz(year, month, day, hour, F.coalesce(number(clock_at + 1), F.lit(0)), second)
        zone = F.replace(F.coalesce(part(zone_at), F.lit("Z")), F.lit(":"), F.lit(""))
        minutes = F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")
        ahead = F.when(zone == "Z", 0).when(zone.startswith("-"), -minutes).otherwise(minutes)
        found.append(F.when(text.rlike(shape), moment - F.make_dt_interval(mins=ahead)))
    return F.coalesce(*found)


def header_timestamp(column, lenient=True):
    """UTC timestamp of a Date header; NULL if it cannot be read.

    The common layouts are read in the JVM, and so are ISO dates, dates with slashes and dates with named
    months. Of 3/4/2024 the month comes first, of 13/4/2024 and 3.4.2024 the day; a date without a clock is midnight,
    one without a zone is UTC; two digits of a year from 69 on mean 19xx. Only what they leave over (and
    nothing else: the worker gets NULL for the rest) goes to Python.
    """
    text = F.regexp_replace(column, r"^\s*[A-Za-z]{3,9},?\s+(?=[0-9])", "")
    text = F.trim(F.regexp_replace(text, r"\s*\([^)]*\)\s*$", ""))
    text = F.regexp_replace(F.regexp_replace(text, NAMED_UTC, " +0000"), r"\s+", " ")
    native = F.coalesce(
        *[
            F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)))
            for layout, shape in ZONED_LAYOUTS.items()
        ]
    )
    # An instant plus a fixed origin: independent of the session time zone.
    seconds = F.make_dt_interval(secs=F.unix_seconds(native).cast("decimal(18,6)"))
    native = F.coalesce(F.lit("1970-01-01").cast("timestamp_ntz") + seconds, _free_form(column))
    if not lenient:
        return native
    left_over = F.when(native.isNull(), column)
    return F.coalesce(native, _lenient_date(left_over))
