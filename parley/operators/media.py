"""Rule tables for media, links and files: ordered conditions as one expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import col

# Link types by part of the address, in order; file categories by extension.
LINK_TYPES = {"video": ["youtube.", "bilibili.", "vimeo."], "music": ["music.", "spotify."], "map": ["map."], "shop": ["taobao.", "jd.com", "amazon."], "article": ["mp.weixin", "zhihu.", "/article"]}
FILE_CATEGORIES = {
    "document": ["doc", "docx", "pdf", "txt", "md", "rtf"], "spreadsheet": ["xls", "xlsx", "csv"], "presentation": ["ppt", "pptx"], "archive": ["zip", "rar", "7z", "tar", "gz"],
    "image": ["jpg", "jpeg", "png", "gif", "webp"], "audio": ["mp3", "wav", "m4a"], "video": ["mp4", "mov", "avi"], "code": ["py", "js", "java", "html"],
}


def link_type(url: Column | str, rules: dict[str, list[str]] = LINK_TYPES, default: str = "web") -> Column:
    """The first rule of which a part occurs in the address."""
    u = F.lower(F.coalesce(col(url), F.lit("")))
    out = F.lit(default)
    for kind, parts in reversed(rules.items()):
        hit = F.contains(u, F.lit(parts[0]))
        for p in parts[1:]:
            hit = hit | F.contains(u, F.lit(p))
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def file_category(name: Column | str, categories: dict[str, list[str]] = FILE_CATEGORIES) -> Column:
    """Category of the extension of a file name; other without a known one."""
    extension = F.lower(F.regexp_extract(F.coalesce(col(name), F.lit("")), "\\.([^./\\\\]+)$", 1))
    pairs = F.create_map(*[F.lit(x) for k, es in categories.items() for e in es for x in (e, k)])
    return F.coalesce(F.element_at(pairs, extension), F.lit("other"))


def file_name(title: Column | str, path: Column | str) -> Column:
    """Title if there is one, else the last part of the path."""
    return F.coalesce(F.nullif(F.trim(col(title)), F.lit("")), F.regexp_extract(F.coalesce(col(path), F.lit("")), "([^/\\\\]+)$", 1))


def image_tier(width: Column | str, height: Column | str, size: Column | str) -> Column:
    """struct(tier, reason, slices): small files and images are skipped, long ones sliced, small ones light, others full."""
    w, h, s = col(width), col(height), col(size)
    large, small = F.greatest(w, h), F.greatest(F.least(w, h), F.lit(1))
    tier = (
        F.when((s > 0) & (s < 5120), F.struct(F.lit("SKIP").alias("tier"), F.lit("file_size").alias("reason")))
        .when(large < 64, F.struct(F.lit("SKIP").alias("tier"), F.lit("dimensions").alias("reason")))
        .when((large / small > 5) & (large > 5000), F.struct(F.lit("SLICE").alias("tier"), F.lit("long").alias("reason")))
        .when(large < 300, F.struct(F.lit("LITE").alias("tier"), F.lit("small").alias("reason")))
        .otherwise(F.struct(F.lit("FULL").alias("tier"), F.lit("").alias("reason")))
    )
    return F.struct(tier["tier"].alias("tier"), tier["reason"].alias("reason"), F.when(tier["tier"] == "SLICE", F.floor(large / 1024).cast("int") + 1).alias("slices"))


def video_tier(width: Column | str, height: Column | str, seconds: Column | str, size: Column | str, least_size: int = 10240) -> Column:
    short = F.least(col(width), col(height))
    return F.when((col(size) > 0) & (col(size) < least_size), "SKIP").when(col(seconds) < 1, "SKIP").when(col(seconds) < 3, "SINGLE_FRAME").when(short <= 240, "LITE").otherwise("FULL")


def sticker_tier(width: Column | str, height: Column | str, size: Column | str, frames: Column | str, least_size: int = 1024) -> Column:
    large = F.greatest(col(width), col(height))
    return F.when((col(size) > 0) & (col(size) < least_size), "SKIP").when(large < 32, "SKIP").when(large < 64, "LITE").when(col(frames) > 100, "LITE").otherwise("FULL")


def page_class(boxes: Column | str, text_share: Column | str, few: int = 3, many: int = 20, little: float = 0.05, much: float = 0.3) -> Column:
    """text, mixed or picture from the number of text boxes and their share of the area."""
    b, t = col(boxes), col(text_share)
    return F.when((b >= many) | (t >= much), "text").when((b <= few) & (t < little), "picture").otherwise("mixed")


def content_type(nsfw: Column | str, sfw: Column | str, text: Column | str, gore_word: Column) -> Column:
    return F.when(col(text) > 0.15, "DOC").when((col(nsfw) > 0.5) & gore_word, "GORE").when(col(nsfw) > 0.5, "NSFW").otherwise("NORMAL")


def magic(content: Column | str) -> Column:
    """Format by the first bytes; unknown below twelve bytes."""
    h = F.hex(F.substring(col(content), 1, 12))
    return (
        F.when(F.length(col(content)) < 12, "unknown").when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("47494638"), "gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").when(h.startswith("424D"), "bmp").when(F.substring(h, 9, 8) == "66747970", "mp4").otherwise("unknown")
    )


def triage_reasons(emotions: str, events: str, text: str, keywords: dict[str, list[str]], wanted_emotions: list[str], wanted_events: list[str]) -> Column:
    """Array of emotion:X, event:Y and category:word reasons of a row."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(f"{c}:{w}")) for c, ws in keywords.items() for w in ws]), lambda x: x.isNotNull())
    pick = lambda c, allowed, name: F.transform(F.array_intersect(F.coalesce(F.col(c), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in allowed])), lambda x: F.concat(F.lit(name + ":"), x))
    return F.concat(pick(emotions, wanted_emotions, "emotion"), pick(events, wanted_events, "event"), words)


def even_stride(frames: Column | str, n: int) -> Column:
    """Indices of n frames spread evenly, or of all if there are fewer."""
    f = col(frames)
    take = F.least(F.lit(n), f)
    return F.when(f > 0, F.transform(F.sequence(F.lit(0), take - 1), lambda i: F.floor(i * f / take).cast("int"))).otherwise(F.array().cast("array<int>"))


def dictionary_encode(df, sha: str, order: str, summary: str):
    """df with `encoded` and `is_ref`: from the second occurrence of a hash on a reference of its first eight characters."""
    from pyspark.sql import Window as W

    w = W.partitionBy(sha).orderBy(order)
    later = F.row_number().over(w) >= 2
    return df.withColumn("is_ref", later).withColumn("encoded", F.when(later, F.concat(F.lit("[REF:"), F.left(F.col(sha), F.lit(8)), F.lit("]"))).otherwise(F.col(summary)))
