"""Timelines: gaps and islands, gap markers, windows by count, gap or time, dense ids, running budgets.

Every window is partitioned by the conversation and ordered by (ts, seq), seq being unique in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions.text import HAN, contains_any, han_runs
from parley.functions.times import describe_gap
from parley.operators import folds, numbering


def by(conv: str = "conv_id", *order: str):
    return W.partitionBy(conv).orderBy(*(order or ("ts", "seq")))


def island_ids(df: DataFrame, breaks: Column, conv: str = "conv_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """df with `island`: 1 for the first row of a conversation, one more at every row where `breaks` (over lag) holds."""
    w = by(conv, *order)
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", F.when(first | F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def _tags_clash(a: Column, b: Column) -> Column:
    hits = []
    for one, two in L.TAG_CONFLICTS:
        x, y = (F.array(*[F.lit(t) for t in g]) for g in (one, two))
        hits.append((F.arrays_overlap(a, x) & F.arrays_overlap(b, y)) | (F.arrays_overlap(a, y) & F.arrays_overlap(b, x)))
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False)) & (F.size(a) > 0) & (F.size(b) > 0)


def merge_messages(df: DataFrame, within: int = 60, short: int = 5, rapid: int = 10, bursts: list[str] = ()) -> DataFrame:
    """Neighbouring text messages of one speaker within `within` seconds become one row.

    Not merged: messages with clashing emotion tags, and pairs of short messages within `rapid` seconds that hold a burst
    pattern. df: conv_id, seq, ts, speaker, modality, text_raw, emotion_tags, msg_uid. The merged row keeps the first
    message's ts, joins the texts by a space if all are shorter than ten characters, else by a newline, and has
    merged_count, original_ids, end_ts and the union of tags.
    """
    w = by()
    before = {c: F.lag(c).over(w) for c in ("speaker", "modality", "ts", "text_raw", "emotion_tags")}
    gap = F.col("ts") - before["ts"]
    burst = F.lit(False)
    if bursts:
        pair = F.concat(F.coalesce(before["text_raw"], F.lit("")), F.coalesce("text_raw", F.lit("")))
        burst = (F.length(before["text_raw"]) <= short) & (F.length("text_raw") <= short) & (gap <= rapid) & contains_any(pair, list(bursts))
    joins = (F.col("speaker") == before["speaker"]) & (F.col("modality") == "text") & (before["modality"] == "text") & (gap <= within) & ~_tags_clash(before["emotion_tags"], F.col("emotion_tags")) & ~F.coalesce(burst, F.lit(False))
    return fold_islands(island_ids(df, ~F.coalesce(joins, F.lit(False))))


def fold_islands(df: DataFrame) -> DataFrame:
    """One row per (conv_id, island) from message rows."""
    rows = F.sort_array(F.collect_list(F.struct("ts", "seq", "msg_uid", "speaker", "modality", "text_raw", F.coalesce("emotion_tags", F.array().cast("array<string>")).alias("tags"))))
    merged = df.groupBy("conv_id", "island").agg(rows.alias("m"))  # an island is bounded by its gaps
    texts = F.filter(F.transform("m", lambda x: x["text_raw"]), lambda t: t != "")
    separator = F.when(F.forall(texts, lambda t: F.length(t) < 10), F.lit(" ")).otherwise(F.lit("\n"))
    first = F.element_at("m", 1)
    return merged.select(
        "conv_id", "island", first["ts"].alias("ts"), first["seq"].alias("seq"), first["msg_uid"].alias("msg_uid"), first["speaker"].alias("speaker"), first["modality"].alias("modality"),
        F.when(separator == " ", F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n")).alias("text_raw"),
        F.size("m").alias("merged_count"), F.transform("m", lambda x: x["msg_uid"]).alias("original_ids"), F.element_at("m", -1)["ts"].alias("end_ts"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: x["tags"])))).alias("emotion_tags"),
    )


def gap_rows(df: DataFrame, least: int = 7200) -> DataFrame:
    """Marker rows between neighbours `least` seconds or more apart: ids of both ends, middle time, gap and kind of break.

    df: conv_id, seq, ts, speaker, text_raw, emotion_tags. Kinds in order: day_change, potential_cold_shoulder (negative
    tag before, speaker changes, an hour or more), topic_change (no common run of Han characters), normal_gap.
    """
    w = by()
    b = {c: F.lag(c).over(w) for c in ("ts", "speaker", "text_raw", "emotion_tags")}
    rows = df.select("conv_id", "seq", "ts", "speaker", "text_raw", "emotion_tags", *[v.alias(f"b_{k}") for k, v in b.items()]).withColumn("gap_seconds", F.col("ts") - F.col("b_ts")).where(F.col("gap_seconds") >= least)
    negative = F.array(*[F.lit(t) for t in L.NEGATIVE_TAGS])
    x, y = han_runs("b_text_raw"), han_runs("text_raw")
    kind = (
        F.when(F.to_date(F.timestamp_seconds("b_ts")) != F.to_date(F.timestamp_seconds("ts")), "day_change")
        .when(F.arrays_overlap("b_emotion_tags", negative) & (F.col("b_speaker") != F.col("speaker")) & (F.col("gap_seconds") >= 3600), "potential_cold_shoulder")
        .when((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y), "topic_change")
        .otherwise("normal_gap")
    )
    return rows.select(
        "conv_id", F.concat(F.lit("TIME_GAP_"), F.col("b_ts"), F.lit("_"), F.col("ts")).alias("msg_uid"), (F.col("b_ts") + F.floor(F.col("gap_seconds") / 2)).alias("ts"), F.lit("SYSTEM").alias("speaker"),
        "gap_seconds", describe_gap("gap_seconds").alias("gap_description"), kind.alias("break_type"), F.col("b_speaker").alias("before_speaker"), F.col("speaker").alias("after_speaker"),
    )


def gap_kind_by_keywords(before: str, after: str, seconds: str, conflict: list[str], brush_off: list[str], cold_hours: float = 4, cooling_hours: float = 12, burst: str = "[!！?？]{2,}", asks: list[str] = ("在吗", "干嘛", "怎么了", "为什么")) -> Column:
    """conflict_cooling, potential_cold_shoulder, topic_change or normal_gap from the two texts and the gap."""
    b, a, hours = F.coalesce(F.col(before), F.lit("")), F.coalesce(F.col(after), F.lit("")), F.col(seconds) / 3600
    x, y = han_runs(b, 2), han_runs(a, 2)
    return (
        F.when((hours >= cooling_hours) & (contains_any(b, list(conflict)) | b.rlike(burst)), "conflict_cooling")
        .when((hours >= cold_hours) & (F.trim(a).isin(list(brush_off)) | (b.rlike("[?？]") & contains_any(b, list(asks)))), "potential_cold_shoulder")
        .when((F.size(x) >= 2) & (F.size(y) >= 2) & ~F.arrays_overlap(x, y), "topic_change")
        .otherwise("normal_gap")
    )


def merge_rapid_fire(df: DataFrame, within: int = 60, separator: str = " | ", rapid: int = 10, max_chars: int = 20, burst: str = "[!！?？]{2,}") -> DataFrame:
    """The second merge variant: rows are not merged while the whole run so far, with the next row, is short and rapid.

    A run stays calm over short and rapid rows, and any other row says anew whether it is, so the state before a row is
    that after the last row which decides it. df: conv_id, seq, ts, speaker, modality, text_raw. Gives conv_id, seq (first),
    ts, speaker, modality, text_raw, merged_count. A conversation may be of any length; only merged rows come together.
    """
    rows = folds.dealt(df.select("conv_id", "seq", "ts", "speaker", "modality", "text_raw"), "conv_id", ["seq"])
    text = F.coalesce("text_raw", F.lit(""))
    rows = rows.withColumn("chars", F.length(text)).withColumn("burst", text.rlike(burst))
    rows = folds.last_known(rows, "conv_id", {"b": F.struct("ts", "speaker", "modality", "burst")}, current=False)
    gap = F.col("ts") - F.col("b.ts")
    able = F.col("b").isNotNull() & F.col("b.speaker").eqNullSafe(F.col("speaker")) & (F.col("b.modality") == "text") & (F.col("modality") == "text") & (gap <= within) & ~F.col("b.burst") & ~F.col("burst")
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False))).withColumn("short", F.col("chars") <= max_chars).withColumn("quick", F.col("able") & F.col("short") & (gap <= rapid))
    calm = F.when(~F.col("able"), F.col("short")).when(~F.col("quick"), F.lit(False))
    rows = folds.last_known(rows, "conv_id", {"calm": calm}, current=False)
    joins = F.col("able") & ~(F.col("quick") & F.col("calm"))
    rows = folds.last_known(rows, "conv_id", {"group": F.when(~joins, F.col("seq"))}, current=True)
    merged = rows.groupBy("conv_id", "group").agg(F.sort_array(F.collect_list(F.struct("seq", "ts", "speaker", "modality", "text_raw"))).alias("m"))
    first = F.element_at("m", 1)
    texts = F.filter(F.transform("m", lambda x: x["text_raw"]), lambda t: t != "")
    text = F.when(F.size("m") == 1, first["text_raw"]).otherwise(F.array_join(texts, separator))
    return merged.select("conv_id", F.col("group").alias("seq"), first["ts"].alias("ts"), first["speaker"].alias("speaker"), first["modality"].alias("modality"), text.alias("text_raw"), F.size("m").alias("merged_count"))


def hopping(df: DataFrame, size: int = 20, step: int = 10, least: int = 10, conv: str = "conv_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Rows dealt to the windows of `size` rows that start every `step` rows: df with start, window position and n.

    Windows at the end may be shorter, but hold `least` rows at least.
    """
    numbered = df.withColumn("i", F.row_number().over(by(conv, *order)) - 1).withColumn("n", F.count("*").over(W.partitionBy(conv)))
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)).cast("int")
    high = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - least) / step)).cast("int")
    spread = numbered.where(high >= low).withColumn("w", F.explode(F.sequence(low, high)))
    return spread.withColumn("start", F.col("w") * step).drop("w")


def tumbling(df: DataFrame, size: int = 10, conv: str = "conv_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """df with `block`: rows 0..size-1 are block 0 and so on."""
    return df.withColumn("block", F.floor((F.row_number().over(by(conv, *order)) - 1) / size))


def sessions(df: DataFrame, gap: int, conv: str = "conv_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """df with `island`: a new one after `gap` seconds or more."""
    return island_ids(df, F.col("ts") - F.lag("ts").over(by(conv, *order)) >= gap, conv, order)


def segment_by_events(df: DataFrame, least: int = 10, most: int = 20, gap: int = 21600, shift: float = 0.5) -> DataFrame:
    """df (conv_id, seq, ts, sentiment) with `segment`: split at `most` rows, or from `least` rows on at a gap or a shift of sentiment.

    A last segment shorter than `least` joins the one before if both fit into `most`, else its rows get null. The split
    depends on the length so far, see folds.run_lengths; a conversation may be of any length.
    """
    rows = folds.last_known(folds.dealt(df, "conv_id", ["seq"]), "conv_id", {"__b": F.struct("ts", "sentiment")}, current=False)
    breaks = (F.col("ts") - F.col("__b.ts") >= gap) | (F.abs(F.col("sentiment") - F.col("__b.sentiment")) >= shift)
    rows = rows.withColumn("__break", F.coalesce(breaks, F.lit(False)))
    segments = folds.run_lengths(rows, "conv_id", "__break", most, lambda length, mark: (length >= most) | ((length >= least) & mark))
    cut = rows.join(segments, [folds.PIECE, folds.AT])
    sizes = cut.groupBy(F.col("conv_id").alias("__c"), "segment").agg(F.count("*").alias("n"))
    last = sizes.groupBy("__c").agg(F.max(F.struct("segment", "n")).alias("last"))
    ends = last.join(sizes.select(F.col("__c").alias("__d"), F.col("segment").alias("__s"), F.col("n").alias("__n")), F.col("__c").eqNullSafe(F.col("__d")) & (F.col("__s") == F.col("last.segment") - 1), "left")
    ends = ends.where(F.col("last.n") < least).select("__c", F.col("last.segment").alias("__tail"), F.when(F.col("__n") + F.col("last.n") <= most, F.col("last.segment") - 1).alias("__to"))
    out = cut.join(ends, cut["conv_id"].eqNullSafe(F.col("__c")) & (F.col("segment") == F.col("__tail")), "left")
    return out.select(*df.columns, F.when(F.col("__tail").isNull(), F.col("segment")).otherwise(F.col("__to")).alias("segment"))


def dense_ids(df: DataFrame, uid: str, seq: str) -> DataFrame:
    """(uid, id): 1, 2, ... in order of first occurrence; the ranking runs over the distinct ids only."""
    first = df.groupBy(uid).agg(F.min(seq).alias("__first"))
    return numbering.numbered(first, ["__first", uid], "id").select(uid, "id")


def compress_times(df: DataFrame, ts: str = "time", conv: str = "conv_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """df with `short_time`: date and time on the first row and on a change of date, else the time."""
    day = F.to_date(ts)
    same = F.lag(day).over(by(conv, *order)).eqNullSafe(day)
    return df.withColumn("short_time", F.when(same, F.date_format(ts, "HH:mm")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm")))


def response_times(df: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Rows that answer another speaker, with `seconds` since the row before."""
    w = by(conv, *order)
    return df.withColumn("__s", F.lag("speaker").over(w)).withColumn("seconds", F.col("ts") - F.lag("ts").over(w)).where("speaker <> __s").drop("__s")


def within_budget(df: DataFrame, chars: str, budget: int, conv: str = "conv_id", order: str = "seq") -> DataFrame:
    """The latest rows of each conversation whose running sum of characters stays within the budget; rank 1 is the latest."""
    w = W.partitionBy(conv).orderBy(F.desc(order))
    return df.withColumn("rank", F.row_number().over(w)).withColumn("used", F.sum(chars).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("used") <= budget)


def recent_and_summary(df: DataFrame, keep: int, summaries: int, conv: str = "conv_id", order: str = "seq", text: str = "text", chars: int = 40) -> DataFrame:
    """Per conversation the last `keep` texts, and of the older ones the last `summaries` cut to `chars` characters."""
    rank = F.row_number().over(W.partitionBy(conv).orderBy(F.desc(order)))
    near = df.withColumn("r", rank).where(F.col("r") <= keep + summaries)
    pick = lambda cond, value: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(order, value.alias("t"))))), lambda x: x["t"])
    return near.groupBy(conv).agg(pick(F.col("r") <= keep, F.col(text)).alias("recent"), pick(F.col("r") > keep, F.left(F.col(text), F.lit(chars))).alias("summary"))


def escalation(df: DataFrame, level: str, conv: str = "conv_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """df with `escalated`: over the three rows before, two orange give RED, three yellow ORANGE, two yellow YELLOW, else GREEN."""
    w = by(conv, *order).rowsBetween(-3, -1)
    orange, yellow = (F.sum(F.when(F.col(level) == c, 1).otherwise(0)).over(w) for c in ("ORANGE", "YELLOW"))
    return df.withColumn("escalated", F.when(orange >= 2, "RED").when(yellow >= 3, "ORANGE").when(yellow >= 2, "YELLOW").otherwise("GREEN"))


def rate(df: DataFrame, seconds: int, key: str, ts: str) -> DataFrame:
    """df with `recent`: rows of the key in the `seconds` up to the row's time, it included."""
    w = W.partitionBy(key).orderBy(ts).rangeBetween(-(seconds - 1), 0)
    return df.withColumn("recent", F.count("*").over(w))


def later_change(df: DataFrame, value: str, lag: int, conv: str, order: str) -> DataFrame:
    """df with `delta`: the value `lag` rows later less this one."""
    return df.withColumn("delta", F.lead(value, lag).over(W.partitionBy(conv).orderBy(order)) - F.col(value))


def cold_rows(df: DataFrame, keywords: list[str], delay: int = 21600, chars: int = 5, look: int = 9, least: int = 3) -> DataFrame:
    """Rows that answer late and coldly, with `cold` later cold rows of the speaker among the next `look`; at least `least` of them."""
    w = by()
    cold = (F.length("text_raw") <= chars) & contains_any("text_raw", keywords)
    rows = df.withColumn("delay", F.col("ts") - F.lag("ts").over(w)).withColumn("is_cold", F.coalesce(cold, F.lit(False)))
    ahead = F.collect_list(F.when(F.col("is_cold"), F.col("speaker"))).over(w.rowsBetween(1, look))  # at most `look` items
    rows = rows.withColumn("cold", F.size(F.filter(ahead, lambda s: s == F.col("speaker"))))
    return rows.where((F.col("delay") > delay) & F.col("is_cold") & (F.col("cold") >= least))


def arguments(df: DataFrame, keywords: list[str], pairs: int = 6, gap: int = 120, least: int = 2) -> DataFrame:
    """Starts of arguments: `pairs` quick changes of speaker in a row of which `least` rows hold a keyword.

    Candidates are found with a frame; those that overlap an earlier start are skipped in order.
    """
    w = by()
    quick = ((F.col("ts") - F.lag("ts").over(w) <= gap) & (F.col("speaker") != F.lag("speaker").over(w))).cast("int")
    rows = df.withColumn("__q", F.coalesce(quick, F.lit(0))).withColumn("__k", contains_any("text_raw", keywords).cast("int")).withColumn("i", F.row_number().over(w))
    marked = rows.withColumn("__qs", F.sum("__q").over(w.rowsBetween(1, pairs))).withColumn("hits", F.sum("__k").over(w.rowsBetween(0, pairs))).where((F.col("__qs") == pairs) & (F.col("hits") >= least))
    starts = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("i")).alias("at"))
    empty = F.array().cast("array<int>")
    kept = F.aggregate("at", empty, lambda acc, i: F.when((F.size(acc) == 0) | (i >= F.element_at(acc, -1) + pairs), F.concat(acc, F.array(i))).otherwise(acc))
    picked = starts.select("conv_id", F.explode(kept).alias("i"))
    return marked.join(picked, ["conv_id", "i"]).drop("__q", "__k", "__qs")


def frame_changes(frames: str, least_overlap: float = 0.6) -> Column:
    """Texts of an array that differ enough in characters from the last one kept."""
    chars = lambda t: F.array_distinct(F.split(t, ""))

    def similar(a, b):
        x, y = chars(a), chars(b)
        return F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)) > least_overlap

    return F.aggregate(F.col(frames), F.array().cast("array<string>"), lambda acc, t: F.when((F.size(acc) > 0) & similar(F.element_at(acc, -1), t), acc).otherwise(F.concat(acc, F.array(t))))


def first_and_last_match(text: str, pattern: str) -> tuple[Column, Column]:
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))
    return F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(-1))
