"""Dates as Spark columns.  Nothing here asks what day it is: callers pass ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def easter(year: Column) -> Column:
    """Sunday of Easter in the Gregorian calendar, by Gauss's rule with Lichtenberg's corrections."""
    y = year.cast("int")
    k = F.floor(y / 100)
    m = 15 + F.floor((3 * k + 3) / 4) - F.floor((8 * k + 13) / 25)
    s = 2 - F.floor((3 * k + 3) / 4)
    a = y % 19
    d = (19 * a + m) % 30
    r = F.floor((d + F.floor(a / 11)) / 29)
    og = 21 + d - r
    sz = 7 - F.pmod(y + F.floor(y / 4) + s, F.lit(7))
    oe = 7 - F.pmod(og - sz, F.lit(7))
    return F.date_add(F.make_date(y, F.lit(3), F.lit(1)), (og + oe - 1).cast("int"))


def age_at(birth: Column, day: Column) -> Column:
    """Whole years at a day."""
    before = F.struct(F.month(day), F.dayofmonth(day)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.year(day) - F.year(birth) - before.cast("int")


def in_recess(day: Column) -> Column:
    """20 December to 20 January."""
    return ((F.month(day) == 12) & (F.dayofmonth(day) >= 20)) | ((F.month(day) == 1) & (F.dayofmonth(day) <= 20))


def seconds_of(ts: Column) -> Column:
    """Whole seconds since 1970 on the clock that a timestamp shows, whatever the session's zone."""
    return F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
