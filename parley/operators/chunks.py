"""Conversation chunks: scoring, selection, formatting, quality, training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions.text import present_words

MULTIMODAL = ["sticker", "image", "voice", "video", "location"]
#: Weights of the chunk types.
TYPE_WEIGHTS = {"conflict": 1.5, "sweet": 1.3, "normal": 1.0}


def score(rows: DataFrame, keys: list[str], negative: list[str] = L.NEGATIVE, positive: list[str] = L.POSITIVE) -> DataFrame:
    """Score and type per chunk from its rows (speaker ME/OTHER, type, searchable text, emotion_tags, break_type).

    Counts are partial sums, so a chunk is never gathered. Variance of lengths is that of the population.
    """
    tags = F.coalesce("emotion_tags", F.array().cast("array<string>"))
    signal = (F.size(tags) > 0) & ~((F.size(tags) == 1) & (F.element_at(tags, 1) == "NEUTRAL"))
    bad_tags = F.when(signal, F.size(F.filter(tags, lambda t: F.upper(t).isin(L.NEGATIVE_TAGS)))).otherwise(0)
    gap = F.when(F.col("type") == "time_gap", F.when(F.col("break_type").isin("cold_period", "argument_gap"), 2.0).when(F.col("break_type") == "topic_change", 1.5).otherwise(1.0)).otherwise(0.0)
    text = F.coalesce("text", F.lit(""))
    g = rows.groupBy(*keys).agg(
        F.sum(present_words(text, negative) + bad_tags).alias("negative"), F.sum(present_words(text, positive)).alias("positive"),
        F.sum(F.length(text)).alias("chars"), F.var_pop(F.length(text)).alias("variance"), F.sum(signal.cast("int")).alias("signals"), F.sum(gap).alias("gaps"),
        F.count_if(F.col("speaker") == "ME").alias("me"), F.count_if(F.col("speaker") == "OTHER").alias("other"), F.count_if(F.col("type").isin(MULTIMODAL)).alias("multimodal"), F.count("*").alias("messages"),
    )
    capped = lambda x: F.least(x, F.lit(1.0))
    kind = F.when((F.col("negative") > F.col("positive")) & (F.col("negative") >= 3), "conflict").when((F.col("positive") > F.col("negative")) & (F.col("positive") >= 3), "sweet").otherwise("normal")
    base = (
        0.25 * (1 - F.abs(F.col("me") - F.col("other")) / F.greatest(F.col("me") + F.col("other"), F.lit(1)))
        + 0.15 * capped(F.col("variance") / 1000)
        + 0.20 * capped(F.col("negative") / 5)
        + 0.15 * capped(F.col("positive") / 5)
        + 0.10 * capped(F.col("chars") / 500)
        + 0.10 * capped(F.col("multimodal") / F.greatest("messages", F.lit(1)) * 2)
        + 0.05 * capped(F.col("signals") / 3)
        + F.least(F.col("gaps") * 0.15, F.lit(0.3))
    )
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv]), kind)
    return g.withColumn("chunk_type", kind).withColumn("score", base * weight).select(*keys, "negative", "positive", "messages", "chunk_type", "score")


def top(chunks: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The n best chunks with a running chunk_id; ties by `order`."""
    best = chunks.orderBy(F.desc("score"), *order).limit(n)
    return best.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.lpad(F.row_number().over(W.orderBy(F.desc("score"), *order)).cast("string"), 4, "0")))


def representatives(chunks: DataFrame, picks: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """One chunk per pick: the first by its order among those its condition selects; a pick without a chunk is absent."""
    out = None
    for name, (condition, order) in picks.items():
        one = chunks.where(condition).orderBy(*order).limit(1).withColumn("pick", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def density(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by modality and their share of all messages but gaps and system rows."""
    told = F.col("type").isin("time_gap", "system")
    per = {m: F.count_if(F.col("type") == m) for m in MULTIMODAL}
    g = rows.groupBy(*keys).agg(*[c.alias(m) for m, c in per.items()], F.count_if(~told).alias("total_messages"))
    total = sum(F.col(m) for m in MULTIMODAL[1:]) + F.col(MULTIMODAL[0])
    return g.withColumn("total_multimodal", total).withColumn("density", F.round(F.col("total_multimodal") / F.greatest("total_messages", F.lit(1)), 3))


def display_line(day: str, time: str) -> Column:
    """`[day time] SPEAKER: text` of a row, with the modality before texts that are not plain; null if there is no text."""
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.col("modality") == "text", text).otherwise(F.concat(F.lit("("), F.col("modality"), F.lit(") "), text))
    return F.when(F.trim(text) != "", F.concat(F.lit("["), F.col(day), F.lit(" "), F.col(time), F.lit("] "), F.col("speaker"), F.lit(": "), body))


def transcript(rows: DataFrame, keys: list[str], line: Column, order: list[str]) -> DataFrame:
    """Lines of each chunk in order, joined by newlines; a chunk is bounded by its window."""
    ordered = F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct(*order, line.alias("line")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("conversation_text"))


def stratified_split(df: DataFrame, key: str, stratum: str, train: float = 0.8, validation: float = 0.1, seed: str = "42") -> DataFrame:
    """df with `split`: within each stratum the order of a hash decides; validation and test get one row each if there are three."""
    n = F.count("*").over(W.partitionBy(stratum))
    place = F.row_number().over(W.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), key))
    cut1 = F.greatest(F.lit(1), F.round(n * train)).cast("int")
    cut2 = F.least(n - 1, cut1 + F.greatest(F.lit(1), F.round(n * validation)).cast("int"))
    split = F.when(n < 3, "train").when(place <= F.least(cut1, n - 2), "train").when(place <= F.greatest(cut2, F.least(cut1, n - 2) + 1), "validation").otherwise("test")
    return df.withColumn("split", split)


def arm(seed: str, run: str, session: Column, turn: Column, share: float) -> Column:
    """prompt or no_prompt: the first 64 bits of the SHA-256 of seed|run|session|turn below `share` of their range."""
    key = F.concat_ws("|", F.lit(seed), F.lit(run), session.cast("string"), turn.cast("string"))
    draw = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)
    return F.when(draw < share, "prompt").otherwise("no_prompt")


def quality(answer: str, thinking: str, sections: list[str]) -> Column:
    """Mean of five parts between 0 and 1: length, thinking, sections present, lines, no refusal."""
    text, think = F.coalesce(F.col(answer), F.lit("")), F.coalesce(F.col(thinking), F.lit(""))
    parts = [
        F.least(F.length(text) / 500, F.lit(1.0)), F.least(F.length(think) / 300, F.lit(1.0)),
        (present_words(text, sections) / max(1, len(sections))) if sections else F.lit(1.0),
        F.least(F.size(F.split(text, "\n")) / 10, F.lit(1.0)), F.when(F.lower(text).rlike("i cannot|i can't|unable to"), 0.0).otherwise(1.0),
    ]
    return (parts[0] + parts[1] + parts[2] + parts[3] + parts[4]) / 5


def chat_record(system: str, user: str, assistant: str) -> Column:
    """messages array of a training record."""
    return F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.col(c), F.lit("")).alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))])


def verdict(total: str, verdict: str) -> Column:
    """pass from 36 points, needs_revision from 20, else fail; from 44 points on pass whatever was said."""
    return F.when(F.col(total) >= 44, "pass").when(F.col(verdict).isNotNull(), F.col(verdict)).when(F.col(total) >= 36, "pass").when(F.col(total) >= 20, "needs_revision").otherwise("fail")


def resolve_status(rounds: str) -> Column:
    """Status of a session from its rounds (struct with level, vote, responded): the last round decides."""
    last = F.try_element_at(F.col(rounds), F.lit(-1))
    return F.when(F.size(rounds) <= 0, "empty").when(last["level"] == "RED", "crisis").when(last["vote"].isNotNull(), "voted").when(last["responded"], "responded").otherwise("in_progress")
