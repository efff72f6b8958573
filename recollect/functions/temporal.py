"""Timestamps in several notations, and the window of time that a question names."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full and short month names, number words and days of a unit (fixed values).
MONTHS = {name.lower(): k for names in (calendar.month_name, calendar.month_abbr) for k, name in enumerate(names) if name}
NUMBERS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "couple of": 2, "a couple of": 2, "few": 3, "a few": 3,
}
UNITS = {"day": 1, "week": 7, "month": 30, "year": 365, "weekend": 3}

#: How times and phrases are written (fixed values).
CLOCK = r"(?i)^(\d{1,2}):(\d{2})\s*([ap]m)\s+on\s+(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})$"
SLASHED = r"^(\d{4})/(\d{2})/(\d{2})(?:\s*\([A-Za-z]+\))?\s*(\d{2}):(\d{2})$"

NUMBER = r"(\d+|a couple of|couple of|a few|few|an|a|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
AGO = rf"\b{NUMBER}\s+(day|week|month|year)s?\s+ago\b"
PAST = rf"\b(?:past|last|previous)\s+{NUMBER}\s+(day|week|month|year)s?\b"
NEAR = r"\b(yesterday|last night|today|this morning|tonight|(?:last|this|past) (?:week|month|year|weekend))\b"
IN_MONTH = rf"\b(?:in|during|of|since)\s+(?:early |late |mid-?)?({'|'.join(sorted(MONTHS, key=lambda m: (-len(m), m)))})\b(?:,?\s+(\d{{4}}))?"
IN_YEAR = r"\bin\s+((?:19|20)\d{2})\b"


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _at(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    return F.call_function("try_make_timestamp_ntz", year, month, day, hour, minute, F.lit(0).cast("decimal(16,6)"))


def _extended(t: Column) -> Column:
    """An ISO time with its date as year-month-day and its clock with colons; other texts as they are."""
    week = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?(?=$|[T ])"
    year, number, day = (F.try_to_number(F.nullif(F.regexp_extract(t, week, k), F.lit("")), F.lit("9999")).cast("int") for k in (1, 2, 3))
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_add(fourth, (number - 1) * 7 - F.weekday(fourth))
    real = (number >= 1) & (F.year(F.date_add(monday, 3)) == year)
    date = F.date_format(F.date_add(monday, F.coalesce(day, F.lit(1)) - 1), "yyyy-MM-dd")
    dated = F.when(t.rlike(week), F.when(real, F.concat(date, F.regexp_replace(t, week, "")))).otherwise(F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3"))
    timed = F.regexp_replace(dated, r"^([0-9-]{10}[T ]\d{2})(\d{2})(\d{2})", "$1:$2:$3")
    timed = F.regexp_replace(timed, r"^([0-9-]{10}[T ]\d{2})(\d{2})(?=$|[Z+-])", "$1:$2")
    return F.regexp_replace(timed, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")


def parsed(text: Column) -> Column:
    """The time a text names, as naive UTC, or null.

    Read are "1:56 pm on 8 May, 2023", "2023/05/20 (Sat) 02:21", and ISO 8601 in its extended and
    compact forms, with week dates, with an offset or without.
    """
    t = F.trim(text)
    long = _extended(t)
    g = lambda pattern, k: F.regexp_extract(t, pattern, k)
    n = lambda pattern, k: F.try_to_number(F.nullif(g(pattern, k), F.lit("")), F.lit("9999")).cast("int")
    hour = n(CLOCK, 1) % 12 + F.when(F.lower(g(CLOCK, 3)) == "pm", 12).otherwise(0)
    clock = _at(n(CLOCK, 6), _lookup(MONTHS, F.lower(g(CLOCK, 5))), n(CLOCK, 4), hour, n(CLOCK, 2))
    slashed = _at(*[n(SLASHED, k) for k in range(1, 6)])
    iso = F.when(long.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(F.try_to_timestamp(long), F.try_to_timestamp(long, F.lit("yyyy-MM-dd'T'HH:mmXXX")), F.try_to_timestamp(long, F.lit("yyyy-MM-dd HH:mmXXX"))).cast("timestamp_ntz"))
    return F.when(t.rlike(CLOCK), clock).when(t.rlike(SLASHED), slashed).otherwise(iso)


def parse_timestamp(text: Column) -> Column:
    """``parsed``, with an error for a text that names no time."""
    return F.coalesce(parsed(text), F.raise_error(F.concat(F.lit("unrecognised timestamp "), F.coalesce(text, F.lit("null")))).cast("timestamp_ntz"))


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def query_window(question: Column, now: Column) -> Column:
    """struct(lo, hi): the half-open time a question names, counted from ``now``; null for none.

    The first pattern that matches decides: so many units ago, the past so many units, a near
    day or unit, a month, a year. Windows are wider than the phrase, as people count roughly.
    """
    q = F.lower(question)
    g = lambda pattern, k: F.regexp_extract(q, pattern, k)
    number = lambda pattern: F.coalesce(_lookup(NUMBERS, g(pattern, 1)), F.when(g(pattern, 1).rlike(r"^\d+$"), g(pattern, 1).cast("int")))
    window = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    ago_unit, past_unit = _lookup(UNITS, g(AGO, 2)), _lookup(UNITS, g(PAST, 2))
    centre, pad = now - _days(number(AGO) * ago_unit), _days(F.greatest(ago_unit, F.lit(2)))
    phrase = g(NEAR, 1)
    which, unit = F.split_part(phrase, F.lit(" "), F.lit(1)), _lookup(UNITS, F.split_part(phrase, F.lit(" "), F.lit(2)))
    near = (
        F.when(phrase.isin("yesterday", "last night"), window(now - _days(F.lit(2)), now))
        .when(phrase.isin("today", "this morning", "tonight"), window(now - _days(F.lit(1)), now + _days(F.lit(1))))
        .when(which.isin("this", "past"), window(now - _days(unit + 1), now + _days(F.lit(1))))
        .otherwise(window(now - _days(unit * 2 + 1), now))
    )
    month = _lookup(MONTHS, g(IN_MONTH, 1))
    named = F.when(g(IN_MONTH, 2) != "", g(IN_MONTH, 2).cast("int"))
    year = F.coalesce(named, F.when(month <= F.month(now), F.year(now)).otherwise(F.year(now) - 1))
    zero, one = F.lit(0), F.lit(1)
    start = _at(year, month, one, zero, zero)
    end = _at(year + F.when(month == 12, 1).otherwise(0), month % 12 + 1, one, zero, zero)
    whole = F.when(g(IN_YEAR, 1) != "", g(IN_YEAR, 1).cast("int"))
    return (
        F.when(q.rlike(AGO), window(centre - pad, centre + pad))
        .when(q.rlike(PAST), window(now - _days(number(PAST) * past_unit + 1), now + _days(one)))
        .when(q.rlike(NEAR), near)
        .when(q.rlike(IN_MONTH), window(start - _days(F.lit(3)), end + _days(F.lit(3))))
        .when(q.rlike(IN_YEAR), window(_at(whole, one, one, zero, zero), _at(whole + 1, one, one, zero, zero)))
    )
