"""Dates as partial text: YYYY-MM-DD-hh-mm, with stars for what isn't known."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def part(value: Column, width: int) -> Column:
    return F.coalesce(F.lpad(value.cast("string"), width, "0"), F.lit("*" * width))


def normal(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    return F.concat_ws("-", part(year, 4), part(month, 2), part(day, 2), part(hour, 2), part(minute, 2))


MONTHS = ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember")
NAMED = r"(?i)\b\d{1,2}\.? (?:" + "|".join(MONTHS) + r") \d{4}\b"


def named(text: Column) -> Column:
    """Normal forms of dates with a German month's name."""
    months = F.array(*[F.lit(m) for m in MONTHS])

    def one(d: Column) -> Column:
        w = F.split(F.lower(F.replace(d, F.lit("."), F.lit(""))), " ")
        return _joined(w[2], F.array_position(months, w[1]).cast("string"), w[0])

    return F.transform(F.regexp_extract_all(text, F.lit(NAMED), F.lit(0)), one)


WEEKDAYS = ("montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag")
MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]}|\\.)?" if len(m) > 3 else m for m in MONTHS) + r")\b\.?"
DAY, YEAR = r"(?<![\d.])(?:0?[1-9]|[12]\d|3[01])", r"(?:\d{4}|'?\d{2})(?!\d)"
#: The forms of a day, tried in this order at every place.
FORMS = re.compile(
    rf"""(?xi) (?P<d1>{DAY})\.[ ]?(?P<m1>0?[1-9]|1[0-2])\.[ ]?(?P<y1>{YEAR})
    | (?P<d2>{DAY})\.?[ ]?(?P<m2>{MONTH})[ ]?(?P<y2>\d{{4}}|'\d{{2}})(?!\d)
    | (?<![\d/-])(?P<y3>\d{{4}})[-/](?P<m3>0[1-9]|1[0-2])[-/](?P<d3>0[1-9]|[12]\d|3[01])(?!\d)
    | (?P<d4>{DAY})\.[ ]?(?P<m4>0?[1-9]|1[0-2])\.(?!\d)
    | (?P<d5>{DAY})\.[ ]?(?P<m5>{MONTH})
    | \b(?P<m6>{MONTH})[ ]?(?P<y6>\d{{4}})(?!\d)""".replace("[ ]", r"[\ ]")
)
BEFORE = re.compile(r"(?i)\b(?:" + "|".join(f"{d[:2]}(?:{d[2:]}|\\.)?" for d in WEEKDAYS) + r")\W*(?:\w+\W*)?$")
#: A time after the day, with at most two words between.
AFTER = re.compile(r"(?i)^(?:\W*[^\W\d]+){0,2}?\W*?\b(?:(?P<h1>[01]?\d|2[0-3])[:.](?P<min>[0-5]\d)(?:\s*uhr)?|(?P<h2>[01]?\d|2[0-3])\s*uhr)\b")


def read_dates(text: str) -> list[tuple[str, str, int, int]]:
    """(normal form, what stands there, start, end) of each date in a German text, a weekday before and a time after it included."""
    out, done = [], 0
    for m in FORMS.finditer(text):
        if m.start() < done:
            continue
        g = {k[0]: v for k, v in m.groupdict().items() if v}
        month = g["m"].lower().strip(".")
        number = int(month) if month.isdigit() else 1 + next(k for k, name in enumerate(MONTHS) if name.startswith(month[:3]))
        year = g.get("y", "").strip("'")
        year = str(2000 + int(year)) if len(year) == 2 else year or "****"
        start, end = m.start(), m.end()
        if (w := BEFORE.search(text, max(done, start - 40), start)) is not None:
            start = w.start()
        hour = minute = "**"
        t, another = AFTER.match(text[end : end + 60]), FORMS.search(text, end, end + 80)
        if t is not None and not (another and another.start() - end <= t.start("h1" if t["h1"] else "h2")):
            hour, minute = f"{int(t['h1'] or t['h2']):02d}", t["min"] or "00"
            end += t.end()
        out.append((f"{year}-{number:02d}-{g['d'].zfill(2) if 'd' in g else '**'}-{hour}-{minute}", text[start:end], start, end))
        done = end
    return out


def extracted(text: Column) -> Column:
    """Dates of every form that read_dates knows, for free text; found() and named() stay in the JVM and know one form each."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(n, f) for n, f, _, _ in read_dates(t or "")])

    return F.pandas_udf(run, "array<struct<norm:string,found:string>>")(text)


def displayed(norm: Column) -> Column:
    """A normal form for readers: "05. März 2010, 14:30 Uhr", without what isn't known; an unknown month is ???."""
    p = F.split(norm, "-")
    known = lambda i, before, after: F.when(F.startswith(p[i], F.lit("*")), "").otherwise(F.concat(F.lit(before), p[i], F.lit(after)))
    names = F.array(*[F.lit(m.capitalize()) for m in MONTHS])
    month = F.coalesce(F.get(names, p[1].try_cast("int") - 1), F.lit("???"))
    hour = F.when(F.startswith(p[3], F.lit("*")), "").otherwise(F.concat(F.lit(", "), p[3], known(4, ":", ""), F.lit(" Uhr")))
    return F.concat(known(2, "", ". "), month, known(0, " ", ""), hour)


def found(text: Column) -> Column:
    """Normal forms of the numeric dates dd.mm.yyyy and yyyy-mm-dd in a text, as an array."""
    german = F.transform(F.regexp_extract_all(text, F.lit(r"\b\d{1,2}\.\d{1,2}\.\d{4}\b"), F.lit(0)), lambda d: _joined(F.split_part(d, F.lit("."), F.lit(3)), F.split_part(d, F.lit("."), F.lit(2)), F.split_part(d, F.lit("."), F.lit(1))))
    iso = F.transform(F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0)), lambda d: F.concat(d, F.lit("-**-**")))
    return F.concat(german, iso)


def _joined(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"), F.lit("**"), F.lit("**"))


def alias(name: str, day: Column) -> Column:
    """The days that a word stands for, as an array of dates. A month later means this month's length in days later."""
    week = F.date_trunc("week", day).cast("date")
    month = F.trunc(day, "month")
    later = F.date_add(day, F.dayofmonth(F.last_day(day)))
    spans = {
        "today": (day, day),
        "tomorrow": (F.date_add(day, 1), F.date_add(day, 1)),
        "this week": (week, F.date_add(week, 6)),
        "next week": (F.date_add(week, 7), F.date_add(week, 13)),
        "this month": (month, F.last_day(day)),
        "next month": (F.trunc(later, "month"), F.last_day(later)),
    }
    return F.sequence(*spans[name])


def newer_than(modified: Column, today: Column, days: int) -> Column:
    """By comparing texts that begin with YYYY-MM-DD."""
    return modified >= F.date_format(F.date_sub(today, days), "yyyy-MM-dd")
