"""Date expressions of a query, read on the driver, and day references inside texts as columns."""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import col

#: The words of a date expression; what is between them ends an expression.
_WORDS = re.compile("(?P<iso>[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})|(?P<number>[0-9]+)|(?P<unit>个月|[年月日号天周])|(?P<to>[到至~-])|(?P<nth>第)|(?P<last>最近|最后|上个|上)|(?P<many>[一两])|(?P<gap>\\s+)|(?P<other>.)", re.S)
_MANY, _LENGTH = {"一": 1, "两": 2}, {"天": 1, "周": 7, "个月": 30, "月": 30}


class _Reader:
    """Reads the words of a question from left to right into what they name.

    Items are ("day", n, marked), ("date", (year or None, month, day)), ("of month", day), ("past", days), ("to",) and ("other",).
    """

    def __init__(self, text: str):
        self.words = [(m.lastgroup, m[0]) for m in _WORDS.finditer(text) if m.lastgroup != "gap"]
        self.at = 0

    def take(self, kind: str, *values: str) -> str | None:
        if self.at < len(self.words):
            have, value = self.words[self.at]
            if have == kind and (not values or value in values):
                self.at += 1
                return value
        return None

    def past(self):
        if (word := self.take("last")) is None:
            return None
        n = self.take("number") or self.take("many")
        unit = self.take("unit", *_LENGTH)
        if unit is None:
            return ("other",)
        count = _MANY.get(n, 1) if n is None or n in _MANY else int(n)
        return ("past", count * _LENGTH[unit]) if n or word.startswith("上") else ("other",)

    def numbered(self):
        nth = self.take("nth")
        if (first := self.take("number")) is None:
            return ("other",) if nth else None
        n = int(first)
        if nth or self.words[self.at : self.at + 1] == [("unit", "天")]:
            return ("day", n, bool(nth), self.take("unit", "天", "日") == "天")
        if self.take("unit", "日", "号"):
            return ("of month", n)
        year = n if self.take("unit", "年") else None
        if year is not None:
            n = int(self.take("number") or 0)
        if not self.take("unit", "月"):
            return ("other",)
        day = int(self.take("number") or 0)
        self.take("unit", "日", "号")
        return ("date", (year, n, day))

    def items(self) -> list[tuple]:
        out = []
        while self.at < len(self.words):
            if iso := self.take("iso"):
                out.append(("date", tuple(int(x) for x in iso.split("-"))))
            elif self.take("to"):
                out.append(("to",))
            else:
                found = self.past() or self.numbered()
                if found is None:
                    self.at += 1
                out.append(found or ("other",))
        return out


def query_days(query: str, day1: datetime.date, last_day: int, year: int | None = None) -> list[int]:
    """Sorted day numbers that a question names: its ranges and past spans, or if it has none its single days.

    A range is two day numbers or two dates with a word or mark for "to" between; its end may be a day of the same month.
    Past spans end at `last_day`. Single day numbers come before full dates, and these before dates without a year,
    which are in `year` (day1's if None). Days after `last_day` + 30, and single day numbers after `last_day`, are left out.
    """
    year, furthest = year or day1.year, last_day + 30

    def day_of(date: tuple) -> int:
        try:
            n = (datetime.date(date[0] or year, date[1], date[2]) - day1).days + 1
        except ValueError:
            return 0
        return n if n <= furthest else 0

    items, spans = _Reader(query).items(), []
    for before, to, after in zip(items, items[1:], items[2:]):
        if to[0] != "to":
            continue
        if before[0] == after[0] == "day" and before[2] and after[3]:
            spans.append((before[1], after[1]))
        elif before[0] == "date" and after[0] in ("date", "of month"):
            spans.append((day_of(before[1]), day_of(after[1] if after[0] == "date" else (*before[1][:2], after[1]))))
    spans += [(max(1, last_day - item[1] + 1), last_day) for item in items if item[0] == "past"]
    found = {n for first, last in spans if 0 < first <= last for n in range(first, min(last, furthest) + 1)}
    if found:
        return sorted(found)
    days = {item[1] for item in items if item[0] == "day" and item[3] and 1 <= item[1] <= last_day}
    full = {day_of(item[1]) for item in items if item[0] == "date" and item[1][0]}
    short = {day_of(item[1]) for item in items if item[0] == "date" and not item[1][0]}
    return sorted(next((s for s in ({n for n in group if n > 0} for group in (days, full, short)) if s), set()))


def days_to_dates(c: Column | str, day1: str, pattern: str = "第(\\d+)天") -> Column:
    """Texts with each day reference as its date; the longest references are replaced first, so none is cut."""
    text = F.coalesce(col(c), F.lit(""))
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), lambda a, b: F.length(b) - F.length(a))
    before, after = pattern.split("(\\d+)")
    return F.aggregate(numbers, text, lambda t, n: F.replace(t, F.concat(F.lit(before), n, F.lit(after)), F.date_format(F.date_add(F.lit(day1).cast("date"), n.cast("int") - 1), "yyyy-MM-dd")))


def day_reference_count(c: Column | str, pattern: str = "第(\\d+)天") -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(pattern))


def query_days_of(query: Column, day1: datetime.date, last_day: int) -> Column:
    """query_days of each text of a column."""

    @F.pandas_udf("array<int>")
    def days(texts: pd.Series) -> pd.Series:
        return pd.Series([query_days(t or "", day1, last_day) for t in texts])

    return days(query)
