"""Matches of patterns with their places in the text, as column functions; a text is read once by one alternation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import col

SPAN = "array<struct<start:int,end:int,type:string,value:string>>"
#: Running sums are taken inside runs of so many elements and over the runs, as a fold copies what it has built so far.
RUN = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often the result names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(values: Column) -> Column:
    """The sums of an array of numbers up to each element."""

    def fold(xs: Column, start: Column) -> Column:
        out = F.struct(start.alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(xs, out, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")), lambda s: s["out"])

    def runs(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / RUN).cast("int")), lambda i: F.slice(xs, i * RUN + 1, F.lit(RUN)))
        return let(parts, lambda ps: F.flatten(F.zip_with(ps, F.concat(F.array(F.lit(0).cast("long")), fold(F.transform(ps, total), F.lit(0).cast("long"))), lambda p, start: F.when(p.isNotNull(), fold(p, start)).otherwise(F.array().cast("array<long>")))))

    total = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x)
    return let(F.transform(values, lambda x: x.cast("long")), runs)


def alternation(patterns: dict[str, str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns.values())


def kind_of(value: Column, patterns: dict[str, str]) -> Column:
    """The first kind whose pattern matches the whole value by itself."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(patterns.items()):
        out = F.when(value.rlike(f"^(?:{pattern})\\z"), kind).otherwise(out)
    return out


def _matches(text: Column, pattern: str, kind: Callable[[Column], Column]) -> Column:
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pairs = F.arrays_zip(found.alias("value"), pieces.alias("before"))  # the last piece has no match after it
    size = lambda p: F.length(p["before"]) + F.coalesce(F.length(p["value"]), F.lit(0))
    span = lambda p: F.struct((p["end"] - F.length(p["value"])).cast("int").alias("start"), p["end"].cast("int").alias("end"), kind(p["value"]).alias("type"), p["value"].alias("value"))
    spans = lambda ps: F.transform(F.slice(F.arrays_zip(ps["value"].alias("value"), running_sums(F.transform(ps, size)).alias("end")), 1, F.size(ps) - 1), span)
    return F.when(text.rlike(pattern), let(pairs, spans)).otherwise(F.array().cast(SPAN))  # most texts have no match and are read once


def find_spans(text: Column | str, patterns: dict[str, str], overlaps: str = "first") -> Column:
    """array of (start, end, type, value) by start: places in code points from 0, the end exclusive.

    `first`: the text is read once, the leftmost match counts and at one place the kind declared first; matches do not
    overlap. `all`: each kind by itself, equal places once, the kind declared first. `longest`: of those the ones that no
    longer one overlaps (of equal ones the earlier). Null texts have no spans. Patterns must not match the empty string;
    a match has the first kind whose pattern matches its value alone.
    """
    t = F.coalesce(col(text), F.lit(""))
    if overlaps == "first":
        return _matches(t, alternation(patterns), lambda v: kind_of(v, patterns)).cast(SPAN)

    def of(order: int, kind: str, pattern: str) -> Column:
        return F.transform(_matches(t, pattern, lambda v: F.lit(kind)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(order).alias("order"), s["type"].alias("type"), s["value"].alias("value")))

    every = F.concat(*[of(i, kind, pattern) for i, (kind, pattern) in enumerate(patterns.items())])
    once = let(F.sort_array(every), lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["start"] != x["start"]) | (F.get(xs, i - 1)["end"] != x["end"])))
    if overlaps == "longest":
        once = longest(once)
    return F.transform(once, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["value"].alias("value"))).cast(SPAN)


def longest(spans: Column) -> Column:
    """Spans (start, end, ...) taken longest first, then by start, of which none overlaps one taken before; by start."""
    by_size = F.array_sort(spans, lambda a, b: F.when((a["end"] - a["start"]) != (b["end"] - b["start"]), (b["end"] - b["start"]) - (a["end"] - a["start"])).otherwise(a["start"] - b["start"]))
    take = lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s)))
    return let(by_size, lambda xs: F.sort_array(F.aggregate(xs, F.slice(xs, 1, 0), take)))


def replace_matches(text: Column | str, patterns: dict[str, str], replacements: dict[str, str]) -> Column:
    """The text with every match of `find_spans` (first) replaced by the text of its kind; what is put in is not read again."""
    t, pattern = col(text), alternation(patterns)
    put = F.create_map(*[F.lit(x) for kind in patterns for x in (kind, replacements.get(kind, f"[{kind}]"))])
    pairs = F.arrays_zip(F.split(t, pattern).alias("before"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("value"))
    replaced = F.array_join(F.transform(pairs, lambda p: F.concat(p["before"], F.coalesce(put[kind_of(p["value"], patterns)], F.lit("")))), "")
    return F.when(t.rlike(pattern), replaced).otherwise(t)
