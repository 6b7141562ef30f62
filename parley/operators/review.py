"""Review of analysed conversations: items by state, Markdown out and in, training records, and small rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import col

TITLES = ("Conversation", "Analysis", "Suggestions")


def state(passed: str = "passed", decision: str = "human_decision") -> Column:
    """pending without a human decision; passed if the model or a human passed it, else failed. An item may be pending and passed."""
    good = F.coalesce(F.col(passed), F.lit(False)) | F.col(decision).eqNullSafe("approve")
    return F.struct(F.col(decision).isNull().alias("pending"), good.alias("passed"), (~good).alias("failed"))


def review_items(items: DataFrame, which: str = "all", chars: int = 200) -> DataFrame:
    """Items (id, conversation, passed, human_decision and any other columns) of a state, all, pending, passed or failed, with a preview."""
    rows = items.withColumn("preview", F.left(F.coalesce("conversation", F.lit("")), F.lit(chars)))
    return rows if which == "all" else rows.where(state()[which])


def review_counts(items: DataFrame) -> DataFrame:
    """One row of counts: total, ai_passed, ai_failed, human_approved, human_rejected, pending."""
    passed = F.coalesce(F.col("passed"), F.lit(False))
    return items.agg(
        F.count("*").alias("total"), F.count_if(passed).alias("ai_passed"), F.count_if(~passed).alias("ai_failed"),
        F.count_if(F.col("human_decision") == "approve").alias("human_approved"), F.count_if(F.col("human_decision") == "reject").alias("human_rejected"), F.count_if(F.col("human_decision").isNull()).alias("pending"),
    )


def to_markdown(id: Column | str, conversation: Column | str, analysis: Column | str, suggestions: Column | str, reviewed: Column | str) -> Column:
    """A page to read and tick: a title, the conversation quoted line by line, the analysis, a list, and a box."""
    text = lambda c: F.coalesce(col(c), F.lit(""))
    quoted = F.array_join(F.transform(F.split(text(conversation), "\n"), lambda l: F.concat(F.lit("> "), l)), "\n")
    listed = F.array_join(F.transform(F.coalesce(col(suggestions), F.array().cast("array<string>")), lambda s: F.concat(F.lit("- "), s)), "\n")
    box = F.when(F.coalesce(col(reviewed), F.lit(False)), "- [x] reviewed").otherwise("- [ ] reviewed")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), col(id).cast("string")), F.lit(f"## {TITLES[0]}"), quoted, F.lit(f"## {TITLES[1]}"), text(analysis), F.lit(f"## {TITLES[2]}"), listed, box)


def from_markdown(page: Column | str) -> Column:
    """(id, conversation, analysis, suggestions, reviewed) of a page of `to_markdown`, edited or not; what is missing is empty.

    The box is ticked by x in either case. Lines of the analysis must not begin with two number signs.
    """
    p = F.regexp_replace(F.coalesce(col(page), F.lit("")), "\r\n?", "\n")
    section = lambda title: F.trim(F.regexp_extract(p, f"(?ms)^## {title}[ \\t]*\\n(.*?)(?=^## |^- \\[[ xX]\\] reviewed|\\z)", 1), F.lit("\n"))
    lines = F.transform(F.filter(F.split(section(TITLES[0]), "\n"), lambda l: l.startswith(">")), lambda l: F.regexp_replace(l, "^> ?", ""))
    items = F.transform(F.filter(F.split(section(TITLES[2]), "\n"), lambda l: l.rlike("^[-*] ")), lambda l: F.trim(F.substring(l, 3, 1 << 30)))
    return F.struct(
        F.regexp_extract(p, "(?m)^# (.*)$", 1).alias("id"), F.array_join(lines, "\n").alias("conversation"), section(TITLES[1]).alias("analysis"), items.alias("suggestions"), p.rlike("(?m)^- \\[[xX]\\] reviewed").alias("reviewed")
    )


def training_records(samples: DataFrame, system: str, task: str, form: str = "chat", only_reviewed: bool = False) -> DataFrame:
    """Records of samples (conversation, analysis, reviewed): `chat` has messages of system, user and assistant, `alpaca` has
    instruction, input and output. The task stands before the conversation, or after the system's text. Missing texts are empty."""
    rows = samples.where(F.coalesce("reviewed", F.lit(False))) if only_reviewed else samples
    said, answer = F.coalesce("conversation", F.lit("")), F.coalesce("analysis", F.lit(""))
    if form == "alpaca":
        return rows.select(F.lit(f"{system}\n\n{task}").alias("instruction"), said.alias("input"), answer.alias("output"))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select(F.array(turn("system", F.lit(system)), turn("user", F.concat(F.lit(f"{task}\n\n"), said)), turn("assistant", answer)).alias("messages"))


def chunk_rows(rows: DataFrame) -> DataFrame:
    """(conversation_id, conversation_text, timestamp, metadata) of chunks under either set of names; all other columns as a map of strings."""
    have = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in rows.columns], F.lit(""))
    rest = [c for c in rows.columns if c not in ("conversation_id", "conversation_text", "timestamp")]
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in rest]), lambda e: e["v"].isNotNull())
    metadata = F.map_from_entries(entries) if rest else F.create_map().cast("map<string,string>")
    return rows.select(have("chunk_id", "conversation_id").alias("conversation_id"), have("conversation", "conversation_text").alias("conversation_text"), have("start_time", "timestamp").alias("timestamp"), metadata.alias("metadata"))


def within_days(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows of the last `days`, and those without a time; all if `days` is not above 0. Times are ISO strings, compared as such."""
    least = F.date_format(now - F.make_dt_interval(F.lit(days)), "yyyy-MM-dd'T'HH:mm:ss")
    return rows if days <= 0 else rows.where(F.col(ts).isNull() | (F.col(ts) == "") | (F.col(ts) >= least))


def latest(results: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key by time, of equal times the one of the largest `tie`."""
    best = results.groupBy(*keys).agg(F.max_by(F.struct(*results.columns), F.struct(at, tie)).alias("r"))
    return best.select("r.*")


def rounds(events: DataFrame, keys: list[str], at: str, agent: str, text: str) -> DataFrame:
    """By keys, such as session and round: agents, events, characters, first and last time, and seconds between them."""
    return events.groupBy(*keys).agg(
        F.sort_array(F.collect_set(agent)).alias("agents"), F.count("*").alias("events"), F.sum(F.length(F.coalesce(text, F.lit("")))).alias("chars"), F.min(at).alias("first"), F.max(at).alias("last"), (F.max(at) - F.min(at)).alias("seconds")
    )


def bias_hits(log: Column | str, label: str = "bias") -> Column:
    """Words after `label=` or `label:` in a line of a log, in order."""
    return F.regexp_extract_all(F.coalesce(col(log), F.lit("")), F.lit(f"\\b{label}[=:]\\s*([\\w-]+)"), F.lit(1))


def quality_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed, however the table is dealt."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), key).limit(n)


def stickers(rows: DataFrame) -> DataFrame:
    """Sticker messages (modality sticker, type 47) with the `url` of text_raw, else of media_path, without the prefix raw/."""
    address = lambda c: F.when(F.col(c).startswith("raw/http"), F.substring(F.col(c), 5, 1 << 30)).when(F.col(c).startswith("http"), F.col(c))
    return rows.where("modality = 'sticker' and type = 47").withColumn("url", F.coalesce(address("text_raw"), address("media_path"))).where("url is not null")


def hotlines(lines: DataFrame, n: int = 3, tie: str = "name") -> DataFrame:
    """The first n by priority, 99 where there is none."""
    return lines.orderBy(F.coalesce("priority", F.lit(99)), tie).limit(n)


def turned(boxes: Column | str, share: float = 0.6, least: int = 3) -> Column:
    """Whether a picture looks turned: of `least` or more text boxes (arrays of points x, y) more than `share` are over 1.2 times as high as wide."""

    def tall(box: Column) -> Column:
        side = lambda axis: F.array_max(F.transform(box, lambda p: p[axis])) - F.array_min(F.transform(box, lambda p: p[axis]))
        return side("y") > 1.2 * side("x")

    b = col(boxes)
    return F.coalesce((F.size(b) >= least) & (F.size(F.filter(b, tall)) / F.size(b) > share), F.lit(False))
