"""Days in many notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.core import let

# Month abbreviations in order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def utc_day(c: Column) -> Column:
    """The UTC calendar day of a time in any usual notation; null if missing or unreadable.

    Read are: ISO dates and times with or without zone (none means UTC), `/` or `.` for `-`,
    eight digits, seconds (10 digits) and milliseconds (13 digits) since 1970, and dates with
    an English month name. The session's time zone has no influence.
    """
    iso = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,]\d+)?\s*(Z|z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?)?$"
    dmy = r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?,?[ -](\d{4})(?: .*)?$"
    mdy = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})(?: .*)?$"
    num = lambda x: F.coalesce(F.nullif(x, F.lit("")).cast("int"), F.lit(0))
    date_of = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    parts = lambda s, pattern, n: F.split(F.regexp_replace(s, pattern, "|".join(f"${i + 1}" for i in range(n))), r"\|")

    def from_iso(x: Column) -> Column:
        digits = F.regexp_replace(x[6], r"\D", "")
        sign = F.when(x[6].startswith("-"), -1).otherwise(1)
        offset = sign * (num(F.substring(digits, 1, 2)) * 3600 + num(F.substring(digits, 3, 2)) * 60)
        seconds = num(x[3]) * 3600 + num(x[4]) * 60 + num(x[5]) - offset
        sane = (num(x[3]) <= 24) & (num(x[4]) < 60) & (num(x[5]) <= 60)
        return F.when(sane, F.date_add(date_of(x[0], x[1], x[2]), F.floor(seconds / 86400).cast("int")))

    def named(x: Column, month: int, day: int) -> Column:
        at = F.instr(F.lit(MONTHS), F.lower(x[month]))
        return F.when(at % 3 == 1, date_of(x[2], ((at + 2) / 3).cast("int").cast("string"), x[day]))

    def read(s: Column) -> Column:
        eight = F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)).try_cast("date")
        epoch = lambda per: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s.try_cast("bigint") / per).cast("int"))
        return (
            F.when(s.rlike(iso), let(parts(s, iso, 7), from_iso))
            .when(s.rlike(r"^\d{8}$"), eight)
            .when(s.rlike(r"^\d{10}$"), epoch(86400))
            .when(s.rlike(r"^\d{13}$"), epoch(86400000))
            .when(s.rlike(dmy), let(parts(s, dmy, 3), lambda x: named(x, 1, 0)))
            .when(s.rlike(mdy), let(parts(s, mdy, 3), lambda x: named(x, 0, 1)))
        )

    # most times are plain ISO in UTC, of which the day is the beginning
    plain = c.rlike(r"^\d{4}-\d\d-\d\d(?:[T ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?Z?)?\z")
    return F.when(plain, F.substring(c, 1, 10).try_cast("date")).otherwise(let(F.trim(F.regexp_replace(c, r"[\s\p{Z}\p{C}]+", " ")), read))
