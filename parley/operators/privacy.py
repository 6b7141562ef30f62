"""Detection and anonymisation of personal data in conversations, reversible (L1) and for sharing (L2)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import spans
from parley.functions.text import col
from parley.functions.times import generalise, relative_day
from parley.operators import numbering

# Default patterns by type, tried in this order.
PATTERNS = {
    "PHONE": "(?<!\\d)1[3-9]\\d{9}(?!\\d)",
    "EMAIL": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}",
    "ID_CARD": "(?<!\\d)\\d{17}[\\dXx](?!\\d)",
    "WECHAT_ID": "wxid_[A-Za-z0-9]+",
}
PLACEHOLDERS = {"PHONE": "[PHONE]", "EMAIL": "[EMAIL]", "ID_CARD": "[ID_CARD]", "WECHAT_ID": "[WECHAT_ID]", "LOCATION": "[LOCATION]", "DATE": "[DATE]"}
#: Fields that hold text to anonymise.
TEXT_FIELDS = ["text_raw", "voice_to_text", "quote_text", "link_title", "ocr_text", "summary", "intent", "emotion_desc", "file_name", "location_label", "contact_nickname"]


def pii_counts(text: Column | str, patterns: dict[str, str] = PATTERNS) -> Column:
    """struct of the number of matches by type; null text has none."""
    t = F.coalesce(col(text), F.lit(""))
    return F.struct(*[F.regexp_count(t, F.lit(p)).alias(k) for k, p in patterns.items()])


def pii_spans(text: Column | str, patterns: dict[str, str] = PATTERNS, overlaps: str = "all") -> Column:
    """array of (start, end, type, value), see find_spans; by default each type finds its own, equal places count once."""
    return spans.find_spans(text, patterns, overlaps)


def redact(text: Column | str, patterns: dict[str, str] = PATTERNS, placeholders: dict[str, str] = PLACEHOLDERS) -> Column:
    """Matches of all types by placeholders in one reading; what was put in is not read again."""
    return spans.replace_matches(text, patterns, placeholders)


def speaker_prefix(text: Column | str, me: list[str]) -> Column:
    """`name: ...` with the name as ME (any case) or OTHER; other texts unchanged."""
    t = col(text)
    name = F.trim(F.regexp_extract(t, "^([^：:]+)[：:]", 1))
    role = F.when(F.lower(name).isin([m.lower() for m in me]), F.lit("ME")).otherwise(F.lit("OTHER"))
    return F.when(name != "", F.concat(role, F.regexp_extract(t, "(?s)^[^：:]+([：:].*)$", 1))).otherwise(t)


def replace_names(text: Column | str, names: dict[str, str], ignore_case: bool = False) -> Column:
    """Names by their replacement, longer names first, so that a name inside another is not hit before it."""
    out = col(text)
    for name in sorted(names, key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, ("(?i)" if ignore_case else "") + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", name), re.sub(r"([\\$])", r"\\\1", names[name]))
    return out


def is_recall(text: Column | str, markers: list[str] = ("撤回了一条消息",)) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    out = t.rlike("(?i)recalled a message")
    for m in markers:
        out = out | F.contains(t, F.lit(m))
    return out


def anonymise_recall(text: Column | str, speaker: Column | str) -> Column:
    """Recall notices name the role only."""
    return F.when(is_recall(text), F.concat(col(speaker), F.lit(" recalled a message"))).otherwise(col(text))


def pseudonyms(df: DataFrame, entity: str, order: str, kind: str = "PERSON") -> DataFrame:
    """(entity, pseudonym): [KIND_n] by first occurrence; the ranking runs over the distinct entities only."""
    first = df.where(F.col(entity).isNotNull() & (F.col(entity) != "")).groupBy(entity).agg(F.min(order).alias("__first"))
    return numbering.numbered(first, ["__first", entity], "__n").select(entity, F.concat(F.lit(f"[{kind}_"), F.col("__n").cast("string"), F.lit("]")).alias("pseudonym"))


def replace_entities(df: DataFrame, entity: str, names: DataFrame) -> DataFrame:
    """df with the entity replaced by its pseudonym."""
    return df.join(names, entity, "left").withColumn(entity, F.coalesce("pseudonym", entity)).drop("pseudonym")


def level1(df: DataFrame, names: dict[str, str] = {}, patterns: dict[str, str] = PATTERNS) -> DataFrame:  # noqa: B006
    """Reversible level: names by pseudonyms and patterns by placeholders in all text fields; recall notices by role."""
    out = {}
    for c in TEXT_FIELDS:
        if c in df.columns:
            clean = redact(replace_names(c, names), patterns)
            out[c] = F.when(is_recall(c), anonymise_recall(c, "speaker")).otherwise(clean) if c == "text_raw" and "speaker" in df.columns else clean
    return df.withColumns(out)


def level2(df: DataFrame, base: str, ts: str = "ts", shift_days: int = 100) -> DataFrame:
    """Level 1 rows with times generalised: day index from the base, period, day type, hour range; ts itself is dropped.

    `base` is a column with the first time of the conversation.
    """
    at = F.timestamp_seconds(F.col(ts) - shift_days * 86400)
    day = relative_day(ts, base)
    out = df.withColumn("day_index", day).withColumn("time_local", F.concat(F.lit("第"), (day + 1).cast("string"), F.lit("天"))).withColumn("generalised", generalise(at))
    return out.select(*[c for c in out.columns if c not in (ts, "generalised")], "generalised.*")


def scan_report(df: DataFrame, key: str, text: str, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """(type, matches, distinct values, messages) over the corpus."""
    t = F.coalesce(text, F.lit(""))

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    values = [of(kind, pattern) for kind, pattern in patterns.items()]
    found = df.select(key, F.explode(F.concat(*values)).alias("s")).select(key, "s.*")
    return found.groupBy("type").agg(F.count("*").alias("matches"), F.count_distinct("value").alias("values"), F.count_distinct(key).alias("messages"))


def name_candidates(df: DataFrame, key: str, text: str, surnames: list[str], exclude: list[str] = (), around: int = 20) -> DataFrame:
    """(key, candidate, context): a surname and one or two Han characters that are not inside a longer run, unless excluded."""
    pattern = f"(?<![\\x{{4e00}}-\\x{{9fff}}])((?:{'|'.join(surnames)})[\\x{{4e00}}-\\x{{9fff}}]{{1,2}})(?![\\x{{4e00}}-\\x{{9fff}}])"
    found = df.select(key, text, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)))).alias("candidate")).where(~F.col("candidate").isin(list(exclude)) if exclude else F.lit(True))
    at = F.expr(f"instr({text}, candidate)")
    start = F.greatest(at - around, F.lit(1))
    return found.select(key, "candidate", F.substring(F.col(text), start, at + F.length("candidate") + around - start).alias("context"))


def risk_level(text: Column | str, tiers: dict[str, list[str]]) -> Column:
    """The first tier (most severe first) of which a word occurs, else NONE."""
    from parley.functions.text import first_label

    return first_label(text, tiers, "NONE")


def crisis(text: Column | str, exact: dict[str, list[str]], personal: dict[str, list[str]], selves: list[str], false_positives: list[str], reach: int = 4, phrases: dict[str, list[tuple[str, bool]]] = {}) -> Column:  # noqa: B006
    """RED, ORANGE, YELLOW or GREEN: the severest tier of which a word occurs.

    Words of `personal` count with a first-person word at most `reach` characters before them; `phrases` have a mark whether
    a first-person word must stand anywhere in the text. A known harmless phrase lowers RED and ORANGE by one level.
    """
    from parley.functions.text import _any, contains_any

    t = F.coalesce(col(text), F.lit(""))
    level = F.lit(0)
    for n, tier in enumerate(("YELLOW", "ORANGE", "RED"), 1):
        hit = contains_any(t, exact.get(tier, []))
        if personal.get(tier) and selves:
            hit = hit | t.rlike(f"({_any(selves)}).{{0,{reach}}}({_any(personal[tier])})")
        told = phrases.get(tier, [])
        hit = hit | contains_any(t, [p for p, own in told if not own]) | (contains_any(t, [p for p, own in told if own]) & contains_any(t, list(selves)))
        level = F.when(hit, F.lit(n)).otherwise(level)
    level = F.when((level >= 2) & contains_any(t, false_positives), level - 1).otherwise(level)
    return F.element_at(F.array(*[F.lit(x) for x in ("GREEN", "YELLOW", "ORANGE", "RED")]), level + 1)
