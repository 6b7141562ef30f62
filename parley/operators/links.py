"""Link, file, quote and mini-program messages: fields by sub type, quote joins, derived keys, headers, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import col
from parley.operators.media import file_category, file_name, link_type
from parley.operators.messages import map_code

# Message sub types of links and files; message types for training.
SUB_TYPES = {"5": "link", "4": "link", "6": "file", "19": "forward", "33": "miniprogram", "36": "miniprogram", "51": "channel", "57": "quote"}
MESSAGE_TYPES = {"text": "文本", "image": "图片", "voice": "语音", "video": "视频", "sticker": "表情", "location": "位置", "contact": "名片", "system": "系统"}
MESSAGE_CODES = {"文本": "text", "图片": "image", "语音": "voice", "视频": "video", "表情": "sticker", "位置": "location", "名片": "contact", "系统": "system", "链接": "link", "文件": "file"}
HEADER = {"msg_uid": "", "ts": 0, "speaker": "OTHER", "modality": "text", "type": 1, "sub_type": 0, "text_raw": "", "media_path": None, "time_local": "", "token": "", "seq": -1, "schema_version": "merged_v2"}
MEDIA_FOLDERS = ["file", "image", "voice", "video", "sticker", "emoji"]


def header(df: DataFrame, overrides: dict[str, Column] | None = None) -> DataFrame:
    """The header columns with defaults for missing values, then overrides (which may be null), then all other columns."""
    made = {}
    for name, default in HEADER.items():
        have = F.col(name) if name in df.columns else F.lit(None)
        kind = "bigint" if isinstance(default, int) else "string"
        made[name] = F.coalesce(have.cast(kind), F.lit(default).cast(kind))
    made |= overrides or {}
    return df.select(*[c.alias(n) for n, c in made.items()], *[c for c in df.columns if c not in made])


def message_code(modality: str, sub_type: str) -> Column:
    """Type code of a message for training: links and files by sub type, others by modality."""
    by_sub = F.element_at(F.create_map(*[F.lit(x) for kv in {"5": "链接", "6": "文件"}.items() for x in kv]), F.col(sub_type).cast("string"))
    label = F.when(F.col(modality) == "link_or_file", F.coalesce(by_sub, F.lit("链接"))).otherwise(map_code(modality, MESSAGE_TYPES, "文本"))
    return F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGE_CODES.items() for x in kv]), label)


def media_path(path: str) -> Column:
    """The path without a leading raw/ that no media folder follows."""
    wrong = F.col(path).rlike(f"^raw/(?!({'|'.join(MEDIA_FOLDERS)})/)")
    return F.when(wrong, F.substring(F.col(path), F.lit(5), F.length(path))).otherwise(F.col(path))


def app_id(text: str, url: str, field: str) -> Column:
    """Mini-program id: the field, else from XML, else from the address."""
    xml = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), p, 1), F.lit("")) for p in ("<appid>([^<]+)</appid>", 'appid="([^"]+)"', "<weappiconurl>[^<]*appid=([\\w]+)", "(wx[0-9a-f]{16})")])
    return F.coalesce(F.nullif(F.trim(F.col(field)), F.lit("")), xml, F.nullif(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "[?&]appid=([^&#]+)", 1), F.lit("")))


def quotes(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """df (msg_uid, quote_text, ...) with quote_text and quote_type of the lookup (svr_id), its own as fallback."""
    q = lookup.groupBy(F.col("svr_id").alias("__k")).agg(F.max_by("quote_text", "seq").alias("__t"), F.max_by("quote_type", "seq").alias("__y"))
    both = df.withColumn("__id", F.element_at(F.split("msg_uid", ":"), -1)).join(q, F.col("__id") == F.col("__k"), "left")
    own = [c for c in df.columns if c not in ("quote_text", "quote_type")]
    return both.select(*own, F.coalesce("__t", "quote_text").alias("quote_text"), F.coalesce("__y", "quote_type").alias("quote_type"))


def extract(df: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Rows of links and files with link_sub_type and the fields of their kind; unknown sub types are marked and kept.

    df: msg_uid, sub_type, text_raw, link_url, link_title, media_path, appid. sizes: (path, length) of files.
    """
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SUB_TYPES.items() for x in kv]), F.col("sub_type").cast("string")), F.lit("unknown"))
    of = lambda k, c: F.when(F.col("link_sub_type") == k, c)
    out = df.withColumn("link_sub_type", kind).withColumn("media_path", media_path("media_path"))
    name = file_name("link_title", "media_path")
    out = out.select(
        "msg_uid", "link_sub_type", "media_path",
        F.when(F.col("link_sub_type").isin("link", "channel", "forward"), F.col("link_title")).alias("link_title"), of("link", F.col("link_url")).alias("link_url"), of("link", link_type("link_url")).alias("link_type"),
        of("file", name).alias("file_name"), of("file", file_category(name)).alias("file_category"), of("miniprogram", app_id("text_raw", "link_url", "appid")).alias("miniprogram_appid"),
        of("quote", F.col("text_raw")).alias("quote_reply"),
    )
    if sizes is None:
        return out.withColumn("file_size", F.lit(None).cast("long"))
    return out.join(sizes.select(F.col("path").alias("media_path"), F.col("length").alias("file_size")), "media_path", "left")


def by_file_name(df: DataFrame, side: DataFrame, path: str, pattern: str, key: str) -> DataFrame:
    """Left join on a key that a pattern takes from the path; `matched` tells of a match."""
    derived = df.withColumn("__k", F.nullif(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), pattern, 1), F.lit("")))
    s = side.withColumnRenamed(key, "__key").withColumn("matched", F.lit(True))
    return derived.join(s, F.col("__k") == F.col("__key"), "left").drop("__k", "__key").withColumn("matched", F.coalesce("matched", F.lit(False)))


def skip_marker(tier: Column | str, reason: Column | str) -> Column:
    """struct(processed, description) of skipped rows, null for others."""
    t = col(tier)
    return F.when(t == "SKIP", F.struct(F.lit(False).alias("processed"), F.concat(F.lit("skipped: "), col(reason)).alias("description")))


def timeline_fields(linkfile: DataFrame, slim: bool = False) -> DataFrame:
    """Columns that go to the timeline: all of a kind, or the slim ones; empty values are null."""
    keep = ["msg_uid", "link_sub_type", "link_title", "file_name"] + ([] if slim else ["link_url", "link_type", "file_category", "file_size", "miniprogram_appid", "quote_reply"])
    return linkfile.select(*[F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) if c != "msg_uid" else F.col(c) for c in keep if c in linkfile.columns])
