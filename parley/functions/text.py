"""Column functions on text: lexicon matches, cleaning, measures and formats. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[\\u4e00-\\u9fff]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(words: list[str]) -> str:
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def contains_any(c: Column | str, words: list[str]) -> Column:
    """Whether any of the words occurs; null text counts as empty. One pass of one pattern, whatever the number of words."""
    return F.coalesce(col(c), F.lit("")).rlike(_any(words)) if words else F.lit(False)


def present_words(c: Column | str, words: list[str]) -> Column:
    """How many of the words occur (each counts once)."""
    text = F.coalesce(col(c), F.lit(""))
    return F.aggregate(F.array(*[F.contains(text, F.lit(w)).cast("int") for w in words]), F.lit(0), lambda s, x: s + x) if words else F.lit(0)


def labels_present(c: Column | str, lexicon: dict[str, list[str]]) -> Column:
    """Labels of which a word occurs, in the lexicon's order."""
    return F.filter(F.array(*[F.when(contains_any(c, words), F.lit(label)) for label, words in lexicon.items()]), lambda x: x.isNotNull())


def first_label(c: Column | str, lexicon: dict[str, list[str]], default: str | None = None) -> Column:
    """The first label of which a word occurs."""
    out = F.lit(default)
    for label, words in reversed(lexicon.items()):
        out = F.when(contains_any(c, words), F.lit(label)).otherwise(out)
    return out


def argmax_label(scores: dict[str, Column]) -> Column:
    """The label of the largest score; of equal ones the first declared."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return F.coalesce(*[F.when(s == best, F.lit(label)) for label, s in scores.items()])


def sentiment(c: Column | str, negative: list[str], positive: list[str]) -> Column:
    """(positive - negative) / (positive + negative) words present, 0 without any."""
    bad, good = present_words(c, negative), present_words(c, positive)
    return F.when(bad + good == 0, F.lit(0.0)).otherwise((good - bad) / (good + bad))


def punctuation_to_space(c: Column | str) -> Column:
    """Punctuation replaced by a space, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "[\\p{P}\\p{S}]", " "), "\\s+", " "))


def collapse_punctuation(c: Column | str) -> Column:
    """Repeats of one punctuation mark become one."""
    return F.regexp_replace(col(c), "([\\p{P}])\\1+", "$1")


def collapse_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), "\\s+", " "))


def clean_unicode(c: Column | str) -> Column:
    """Without replacement, private-use and surrogate characters and controls but newline, tab and return; empty becomes null."""
    out = F.regexp_replace(col(c), "[\\x{FFFD}\\p{Cs}\\p{Co}]|[\\p{Cc}&&[^\\n\\t\\r]]", "")
    return F.when(out != "", out)


def patch(c: Column | str, patches: dict[str, str]) -> Column:
    """Literal replacements in order."""
    out = col(c)
    for old, new in patches.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def patch_count(c: Column | str, patches: dict[str, str]) -> Column:
    """Occurrences of the replaced literals, each counted on the text as it was."""
    text = F.coalesce(col(c), F.lit(""))
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("int") for old in patches)


def is_repetitive(c: Column | str, min_chars: int = 10, min_words: int = 4, share: float = 0.5) -> Column:
    """Whether one word makes up more than `share` of a text of enough characters and words."""
    words = F.filter(F.split(F.coalesce(col(c), F.lit("")), "\\s+"), lambda w: w != "")
    largest = F.array_max(F.transform(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w))))
    return (F.length(F.trim(F.coalesce(col(c), F.lit("")))) >= min_chars) & (F.size(words) >= min_words) & (F.coalesce(largest, F.lit(0)) / F.size(words) > share)


def distinct_words(c: Column | str, ignore_case: bool = False) -> Column:
    """Words in order of their first occurrence, without later repeats, joined by a space."""
    words = F.filter(F.split(F.coalesce(col(c), F.lit("")), "\\s+"), lambda w: w != "")
    if ignore_case:
        lower = F.transform(words, F.lower)
        words = F.filter(words, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1)
    return F.array_join(F.array_distinct(words), " ")


def estimate_tokens(c: Column | str) -> Column:
    """Han characters / 1.5 + other characters / 4, cut to an integer."""
    text = F.coalesce(col(c), F.lit(""))
    han = F.regexp_count(text, F.lit(HAN))
    return (han / 1.5 + (F.length(text) - han) / 4).cast("long")


def ellipsis(c: Column | str, limit: int, placeholder: str = "") -> Column:
    """Text of at most `limit` characters; longer ones end in an ellipsis. Blank texts give the placeholder."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(text == "", F.lit(placeholder)).when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…"))).otherwise(text)


def han_runs(c: Column | str, least: int = 1) -> Column:
    """Distinct runs of at least `least` Han characters, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"({HAN}{{{least},}})"), F.lit(1))))


def tokens(c: Column | str) -> Column:
    """Distinct lower-case Latin words of two letters or more, Han runs of two or more and their pairs of neighbours, sorted."""
    text = F.coalesce(col(c), F.lit(""))
    latin = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(f"({HAN}{{2,}})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_sort(F.array_distinct(F.concat(latin, runs, pairs)))


def char_jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the sets of characters; 0 if both are empty."""
    chars = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(col(c), F.lit("")), ""), lambda x: x != ""))
    x, y = chars(a), chars(b)
    return F.when(F.size(F.array_union(x, y)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def excerpt(c: Column | str, needle: Column, around: int = 40) -> Column:
    """Lower-cased text around the first occurrence of a lower-case needle; null if it does not occur."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    at = F.instr(text, needle) if isinstance(needle, str) else F.locate(needle, text) if isinstance(needle, str) else F.position(needle, text)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + F.length(needle) + around - start))


def strip_thinking(c: Column | str) -> Column:
    """Text without <think>...</think> blocks."""
    return F.trim(F.regexp_replace(col(c), "(?s)<think>.*?</think>", ""))


def json_block(c: Column | str) -> Column:
    """The JSON of a text: the first fenced block, else from the first to the last brace; thinking blocks are cut first."""
    text = strip_thinking(c)
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.nullif(F.regexp_extract(text, "(?s)(\\{.*\\})", 1), F.lit("")))


def format_size(c: Column | str) -> Column:
    """Bytes as B, KB, MB or GB with two decimals from KB on."""
    n = col(c)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        out = F.when(n >= size, F.concat(F.format_string("%.2f", F.round(n / size, 2)), F.lit(f" {unit}"))).otherwise(out)
    return out
