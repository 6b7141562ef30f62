"""Rule scores: styles and defences by lexicon, routing by complexity, eligibility, questionnaires, summaries of media texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import argmax_label, col, contains_any, first_label, labels_present, present_words

# Language marks of defences and the words that make a task complex.
DEFENCES = {
    "否认": ["没有", "不是", "我没", "才不是"], "投射": ["你才是", "你自己", "你不也是"], "合理化": ["因为", "所以", "只是", "不得不"], "分裂": ["完全", "总是", "从来", "永远"],
    "理想化": ["最好", "完美", "最爱"], "贬低": ["最差", "最烦", "讨厌死"], "退行": ["不管了", "随便", "爱咋咋"], "压抑": ["算了", "不说了", "没什么"],
}
COMPLEX = ["生气", "愤怒", "伤心", "难过", "失望", "绝望", "焦虑", "恐惧", "厌恶", "嫉妒", "冷战", "分手", "离婚", "出轨", "背叛", "欺骗", "家暴", "控制"]
AGENT_POINTS = {"psychoanalytic": 0.3, "supportive": 0.1}
FEELINGS = ["自信", "自豪", "歉意", "内疚", "焦虑", "担心", "开心", "兴奋", "失望", "沮丧", "愤怒", "不满", "疑惑", "困惑", "期待", "渴望", "自嘲", "幽默", "讽刺", "无奈", "委屈", "撒娇"]
FEELINGS_KEPT = [*FEELINGS, "真诚", "诚恳", "积极", "乐观", "消极", "悲观"]
FILLERS = ["根据语音内容，?", "可以感受到", "整体上，?", "总体上，?"]


def speaker_marks(rows: DataFrame, keys: list[str], text: str, styles: dict[str, list[str]], defences: dict[str, list[str]] = DEFENCES, most: int = 3) -> DataFrame:
    """Per key and side (ME or OTHER): the style of most marks and up to three defences, in declared order.

    Marks are flags by row, so a conversation's texts are never joined into one.
    """
    side = F.when(F.col("speaker") == "ME", "ME").otherwise("OTHER")
    flag = lambda w: F.max(F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(w)).cast("int"))
    g = rows.groupBy(*keys, side.alias("side")).agg(
        *[sum((flag(w) for w in words[1:]), flag(words[0])).alias(f"s{i}") for i, words in enumerate(styles.values())],
        *[F.max(contains_any(text, words)).alias(f"d{i}") for i, words in enumerate(defences.values())],
    )
    scores = {label: F.col(f"s{i}") for i, label in enumerate(styles)}
    total = sum((F.col(f"s{i}") for i in range(1, len(styles))), F.col("s0"))
    found = F.filter(F.array(*[F.when(F.col(f"d{i}"), F.lit(label)) for i, label in enumerate(defences)]), lambda x: x.isNotNull())
    return g.select(*keys, "side", F.when(total == 0, "none").otherwise(argmax_label(scores)).alias("style"), F.slice(found, 1, most).alias("defences"))


def complexity(text: Column | str, agent: Column | str, words: list[str] = COMPLEX) -> Column:
    """Points for length, for words present (0.05 each, 0.3 at most) and for the agent, 1 at most."""
    n = F.length(F.coalesce(col(text), F.lit("")))
    points = F.when(n > 3000, 0.3).when(n > 1000, 0.15).otherwise(0.0) + F.least(present_words(text, words) * 0.05, F.lit(0.3))
    extra = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in AGENT_POINTS.items() for x in kv]), col(agent)), F.lit(0.0))
    return F.least(points + extra, F.lit(1.0))


def route(score: Column, tokens: Column, over_budget: Column, simple: float = 0.3, medium: float = 0.7, long: int = 32_000) -> Column:
    """Long inputs first, then the budget, then the score."""
    return F.when(tokens > long, "long_context").when(over_budget, "fallback").when(score <= simple, "local").when(score <= medium, "local_thinking").otherwise("cloud")


def eligibility(score: str, label: str, since: str, turn: str, threshold: float, crisis: list[str], min_turn: int, cooldown: int) -> Column:
    """struct of the single reasons and whether a point is eligible; without a score it is not."""
    hit = F.coalesce(F.col(score) <= threshold, F.lit(False))
    blocked = [F.coalesce(F.col(label).isin(crisis), F.lit(False)), F.col(since) < cooldown, F.col(turn) < min_turn]
    return F.struct(hit.alias("trigger_hit"), blocked[0].alias("crisis_block"), blocked[1].alias("cooldown_block"), blocked[2].alias("min_turn_block"), (hit & ~blocked[0] & ~blocked[1] & ~blocked[2]).alias("eligible"))


def screening(total: Column | str, cut: int = 3) -> Column:
    return F.when(col(total) >= cut, "positive").otherwise("negative")


def dominant(answers: dict[str, str], missing: int = 3) -> Column:
    """The dimension with the largest answer, missing ones as the middle; of equal ones the first."""
    return argmax_label({dim: F.coalesce(F.col(c), F.lit(missing)) for dim, c in answers.items()})


def analysis_worth_keeping(analysis: Column | str) -> Column:
    """Long enough, not a plain statement of calm, and with a feeling or more than 50 characters."""
    t = F.coalesce(col(analysis), F.lit(""))
    return (F.length(t) >= 20) & ~t.rlike("^(语气.*平静|没有明显.*情绪|情绪.*中性|语气.*中性)") & (contains_any(t, FEELINGS) | (F.length(t) > 50))


def condense_analysis(analysis: Column | str, target: int = 50, clauses: int = 3) -> Column:
    """The first clauses with a feeling, else the beginning; at most `target` characters."""
    t = F.coalesce(col(analysis), F.lit(""))
    for filler in FILLERS:
        t = F.regexp_replace(t, filler, "")
    parts = F.filter(F.transform(F.split(t, "[。，]"), lambda s: F.trim(s)), lambda s: (F.length(s) >= 5) & contains_any(s, FEELINGS_KEPT))
    out = F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, clauses), "，")).otherwise(F.left(t, F.lit(target)))
    return F.when(F.length(out) > target, F.concat(F.left(out, F.lit(target - 3)), F.lit("..."))).otherwise(out)


def voice_summary(df: DataFrame, text: str, analysis: str, target: int = 50) -> DataFrame:
    """df with analysis_summary, original_length, compressed_length, compression_ratio."""
    summary = F.when(analysis_worth_keeping(analysis), condense_analysis(analysis, target))
    before = F.length(F.coalesce(text, F.lit(""))) + F.length(F.coalesce(analysis, F.lit("")))
    after = F.length(F.coalesce(text, F.lit(""))) + F.coalesce(F.length(summary), F.lit(0))
    return df.withColumn("analysis_summary", summary).withColumn("original_length", before).withColumn("compressed_length", after).withColumn("compression_ratio", F.round(F.when(after > 0, before / after).otherwise(1.0), 2))


def merge_strategy(frames: Column) -> Column:
    n = F.size(frames)
    return F.when(n <= 5, "sequential").when(n <= 10, "segmented").otherwise("key_changes")


def frame_summary(frames: str, most: int = 150) -> Column:
    """Frames by strategy: all of few, first, middle and last of more, changes of many; cut to `most` characters."""
    from parley.operators.timeline import frame_changes

    f = F.col(frames)
    few = F.array_join(f, "；")
    ends = F.array_join(F.array(F.try_element_at(f, F.lit(1)), F.try_element_at(f, F.floor(F.size(f) / 2).cast("int") + 1), F.try_element_at(f, F.lit(-1))), "；")
    how = merge_strategy(f)
    return F.left(F.when(how == "sequential", few).when(how == "segmented", ends).otherwise(F.array_join(frame_changes(frames), "；")), F.lit(most))


def image_summary(caption: str, ocr: str, most: int = 150, keep_ocr: int = 60) -> Column:
    """Caption and the beginning of the OCR text, cut at the last sentence end within `most` characters."""
    c, o = F.trim(F.coalesce(F.col(caption), F.lit(""))), F.trim(F.coalesce(F.col(ocr), F.lit("")))
    both = F.when(o == "", c).when(c == "", F.left(o, F.lit(most))).otherwise(F.concat(c, F.lit(" | "), F.left(o, F.lit(keep_ocr))))
    cut = F.regexp_extract(F.left(both, F.lit(most)), "(?s)^(.*[。.!！?？])", 1)
    return F.when(F.length(both) <= most, both).when(cut != "", cut).otherwise(F.left(both, F.lit(most)))


def sticker_intent(caption: str, ocr: str, by_ocr: dict[str, list[str]], tiers: list[tuple[float, dict[str, list[str]]]], default: tuple[str, float] = ("other", 0.3)) -> Column:
    """struct(intent, confidence): OCR rules first, then the tiers of caption rules in order."""
    found = [(0.95, first_label(ocr, by_ocr))] + [(w, first_label(caption, rules)) for w, rules in tiers]
    intent, confidence = F.lit(default[0]), F.lit(default[1])
    for weight, label in reversed(found):
        intent, confidence = F.coalesce(label, intent), F.when(label.isNotNull(), weight).otherwise(confidence)
    return F.struct(intent.alias("intent"), confidence.alias("confidence"))


def motion(scores: DataFrame, key: str, value: str, high: float = 0.5) -> DataFrame:
    """(key, intensity): 0.3 mean + 0.4 ninetieth percentile + 0.3 share of high ones, 1 at most."""
    raw = 0.3 * F.avg(value) + 0.4 * F.percentile(value, 0.9) + 0.3 * F.avg((F.col(value) > high).cast("int"))
    return scores.groupBy(key).agg(F.least(raw, F.lit(1.0)).alias("intensity"))


def category_labels(text: Column | str, lexicon: dict[str, list[str]], most: int) -> Column:
    return F.slice(labels_present(text, lexicon), 1, most)
