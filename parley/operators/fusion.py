"""Merging analyses and captions, replacement with look-around, safe rendering of analysis fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import char_jaccard, patch

RISKS = ["none", "low", "medium", "high", "critical"]


def largest_risk(*columns: str) -> Column:
    """The most severe of risk levels; null and unknown ones count as none."""
    place = F.create_map(*[F.lit(x) for i, r in enumerate(RISKS) for x in (r, i)])
    ranks = [F.coalesce(F.element_at(place, F.lower(F.col(c))), F.lit(0)) for c in columns]
    return F.element_at(F.array(*[F.lit(r) for r in RISKS]), (F.greatest(*ranks) if len(ranks) > 1 else ranks[0]) + 1)


def merge_analyses(df: DataFrame, sources: dict[str, str], lists: list[str], texts: list[str], risk: str, most: int = 4) -> DataFrame:
    """One analysis from several struct columns (name to column): lists united in order, texts appended, largest risk.

    `merged_from` names the sources that are not null.
    """
    cols = list(sources.values())
    made = []
    for f in lists:
        parts = [F.coalesce(F.col(f"{c}.{f}"), F.array().cast("array<string>")) for c in cols]
        made.append(F.slice(F.array_distinct(F.filter(F.transform(F.concat(*parts), lambda s: F.trim(s)), lambda x: x != "")), 1, most).alias(f))
    for f in texts:
        made.append(F.concat_ws(" / ", F.array_distinct(F.filter(F.array(*[F.nullif(F.trim(F.col(f"{c}.{f}")), F.lit("")) for c in cols]), lambda x: x.isNotNull()))).alias(f))
    risks = df.withColumns({f"__r{i}": F.col(f"{c}.{risk}") for i, c in enumerate(cols)})
    named = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in sources.items()]), lambda x: x.isNotNull()), "+")
    return risks.select(*[c for c in df.columns if c not in cols], *made, largest_risk(*[f"__r{i}" for i in range(len(cols))]).alias(risk), named.alias("merged_from"))


def fuse_captions(first: str, second: str, alike: float = 0.6) -> Column:
    """The first text's sentences and those of the second that are not like one of them."""
    sentences = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "(?<=[.!?。！？])\\s*"), lambda s: F.trim(s)), lambda s: s != "")
    a, b = sentences(first), sentences(second)
    new = F.filter(b, lambda s: ~F.exists(a, lambda t: char_jaccard(s, t) > alike))
    return F.array_join(F.concat(a, new), " ")


def restore(text: Column, literals: dict[str, str], roles: dict[str, str]) -> Column:
    """Pseudonyms back to names: literal ones first, longest first, then role words that stand alone."""
    out = patch(text, {k: literals[k] for k in sorted(literals, key=lambda k: (-len(k), k))})
    for role, name in roles.items():
        out = F.regexp_replace(out, f"(?<![A-Z_]){role}(?![A-Z_])", name.replace("$", "\\$"))
    return out


def restore_messages(messages: str, literals: dict[str, str], roles: dict[str, str]) -> Column:
    """The same inside an array of (role, content)."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), restore(m["content"], literals, roles).alias("content")))


def numbered(items: str, terms: dict[str, str]) -> Column:
    """Items as numbered lines with terms replaced."""
    return F.array_join(F.transform(F.col(items), lambda x, i: F.format_string("  %d. %s", i + 1, patch(x, terms))), "\n")


def guard(text: str, banned: list[str], softer: dict[str, str], notice: str) -> Column:
    """A text with softer words, or the notice if a banned word is in it."""
    from parley.functions.text import contains_any

    return F.when(contains_any(text, banned), F.lit(notice)).otherwise(patch(text, softer))


def six_dimensions(analysis: str, dims: list[str]) -> Column:
    """struct of numeric scores of a JSON analysis, null if all are missing."""
    values = [F.get_json_object(F.col(analysis), f"$.{d}.score").try_cast("double").alias(d) for d in dims]
    return F.when(F.coalesce(*values).isNotNull(), F.struct(*values))


def one_or_many(json: str, path: str) -> Column:
    """A JSON value as an array of strings: a list as it is, a single string as a list of one, else empty."""
    value = F.get_json_object(F.col(json), path)
    return F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
