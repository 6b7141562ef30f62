"""Readers of message exports. Each gives rows with line or element numbers, since order has a meaning."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.times import CHAT_FORMATS, parse
from parley.operators.messages import apply_mapping, map_code


def lines(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    """(file, line_no, line) from 1 within each file, without blank lines if not `blank`, which then have no numbers.

    Splits of a file do not know their line numbers: each is counted, and its lines are numbered from the sum of those before.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    rows = (raw if blank else raw.where(F.trim("line") != "")).withColumn("id", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    return rows.join(blocks.withColumn("before", before).drop("n"), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "line")


def jsonl(spark: SparkSession, path: str, schema: str, numbered: bool = False) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are skipped. With numbers, file and line_no come first."""
    source = lines(spark, path) if numbered else spark.read.text(path).withColumnRenamed("value", "line")
    parsed = source.where(F.trim("line") != "").withColumn("r", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})).where("r._bad is null and r is not null")
    return parsed.select(*(["file", "line_no"] if numbered else []), "r.*").drop("_bad")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def mapped_csv(spark: SparkSession, path: str, mapping: dict[str, str], prefix: str, participants: dict[str, str] | None = None) -> DataFrame:
    """CSV rows by a field mapping: msg_uid is prefix:row, numbers that do not parse are 0, speakers by participants."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    numbered = rows.select("*", F.col("_metadata.file_path").alias("__file")).withColumn("__id", F.monotonically_increasing_id())
    numbered = numbered.withColumn("__n", F.row_number().over(W.partitionBy("__file").orderBy("__id")))
    out = apply_mapping(numbered, mapping | {"__n": "__n"})
    for c in ("ts", "type", "sub_type"):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)))
    if participants and "speaker" in out.columns:
        out = out.withColumn("speaker", F.coalesce(map_code("speaker", participants), "speaker"))
    return out.withColumn("msg_uid", F.concat(F.lit(prefix + ":"), "__n")).drop("__n")


def mapped_jsonl(spark: SparkSession, path: str, mapping: dict[str, str], prefix: str = "JSONL", participants: dict[str, str] | None = None) -> DataFrame:
    """JSON lines by a field mapping, see apply_mapping: msg_uid is prefix:n, n counting the lines that are not blank, those
    that are no JSON object too, though they give no row. Numbers that do not parse are 0. With participants, names without
    one become OTHER:name."""
    numbered = lines(spark, path, blank=False).withColumn("m", F.from_json(F.trim("line"), "map<string,string>")).where("m is not null")
    sources = [k for k in mapping if not k.startswith(("_const:", "_default:"))]
    rows = numbered.select(F.col("line_no").alias("__n"), *[F.col("m")[k].alias(k) for k in sources])
    out = apply_mapping(rows, mapping | {"__n": "__n"})
    for c in ("ts", "type", "sub_type"):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)))
    if participants and "speaker" in out.columns:
        named = F.col("speaker").isin("ME", "OTHER") | F.col("speaker").startswith("OTHER:")
        out = out.withColumn("speaker", F.coalesce(map_code("speaker", participants), F.when(named, F.col("speaker")).otherwise(F.concat(F.lit("OTHER:"), "speaker"))))
    return out.withColumn("msg_uid", F.concat(F.lit(prefix + ":"), "__n")).drop("__n")


def telegram(spark: SparkSession, path: str, participants: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Messages of a JSON export: mixed text arrays joined, dates to epoch seconds (0 if unreadable), modality by field."""
    doc = spark.read.schema("messages array<struct<id: long, type: string, date: string, `from`: string, text: variant, media_type: string, photo: string, file: string>>").option("multiLine", True).json(path)
    m = doc.select(F.posexplode("messages").alias("seq", "m")).where("m.type = 'message'").select("seq", "m.*")
    raw = F.to_json("text")
    parts = F.from_json(raw, "array<string>")
    piece = lambda p: F.coalesce(F.get_json_object(p, "$.text"), p)
    text = F.when(raw.startswith("["), F.array_join(F.transform(parts, piece), "")).otherwise(F.variant_get("text", "$", "string"))
    kind = F.when(F.col("photo").isNotNull(), "image").otherwise(F.coalesce(map_code("media_type", {"voice_message": "voice", "video_message": "video", "video_file": "video", "sticker": "sticker", "animation": "sticker", "audio_file": "voice"}), F.when(F.col("file").isNotNull(), "link_or_file").otherwise("text")))
    speaker = F.coalesce(map_code("from", participants) if participants else F.lit(None), F.concat(F.lit("OTHER:"), F.coalesce("from", F.lit(""))))
    return m.select(
        F.concat(F.lit("TG:"), "id").alias("msg_uid"), F.coalesce(F.unix_timestamp(F.try_to_timestamp("date")), F.lit(0)).alias("ts"), speaker.alias("speaker"), F.lit(1).alias("type"),
        kind.alias("modality"), F.coalesce(text, F.lit("")).alias("text_raw"), F.coalesce("photo", "file").alias("media_path"), "seq",
    )


#: Header line of a chat export: date, sender, text.
CHAT_LINE = "^\\u200e?\\[?(\\d{1,2}[/.]\\d{1,2}[/.]\\d{2,4},? \\d{1,2}:\\d{2}(?::\\d{2})?(?:[\\s\\u202f][AaPp][Mm])?)\\]?(?: -)? ([^:]+): (.*)$"


def chat_text(spark: SparkSession, path: str, participants: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Messages of a text export; lines without a header continue the message before. msg_uid is WA:first line."""
    rows = lines(spark, path).withColumn("head", F.col("line").rlike(CHAT_LINE))
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    grouped = rows.withColumn("g", F.sum(F.col("head").cast("int")).over(w)).where("g > 0").groupBy("file", "g").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    first = F.element_at("l", 1)
    m = grouped.select("file", first["line_no"].alias("line_no"), *[F.regexp_extract(first["line"], CHAT_LINE, i).alias(n) for i, n in ((1, "date"), (2, "sender"), (3, "text"))], F.slice("l", F.lit(2), F.size("l")).alias("more"))
    text = F.array_join(F.concat(F.array("text"), F.transform("more", lambda x: x["line"])), "\n")
    file = F.regexp_extract("text", "([\\w-]+\\.(\\w+)) \\(file attached\\)", 1)
    extension = F.lower(F.regexp_extract(file, "\\.(\\w+)$", 1))
    kind = F.when(F.contains("text", F.lit("<Media omitted>")), "image").when(extension == "", "text").when(extension.isin("jpg", "jpeg", "png"), "image").when(extension.isin("opus", "mp3", "m4a"), "voice").when(extension.isin("mp4", "mov"), "video").when(extension == "webp", "sticker").otherwise("link_or_file")
    speaker = F.coalesce(map_code("sender", participants) if participants else F.lit(None), F.concat(F.lit("OTHER:"), "sender"))
    when = parse(F.regexp_replace(F.upper("date"), "\\x{202F}", " "), CHAT_FORMATS)
    return m.select(F.concat(F.lit("WA:"), "line_no").alias("msg_uid"), F.coalesce(F.unix_timestamp(when), F.lit(0)).alias("ts"), speaker.alias("speaker"), F.lit(1).alias("type"), kind.alias("modality"), text.alias("text_raw"), F.nullif(file, F.lit("")).alias("media_path"), F.col("line_no").alias("seq"))


def balanced(text: str, start: int) -> str | None:
    """The bracketed text from `start` on, strings and escapes minded; null if it does not end."""
    depth, quote, skip = 0, "", False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quote:
            if c == "\\":
                skip = True
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_messages(html: pd.Series) -> pd.Series:
    """JSON objects of the array `chatMessages = [...]` of an HTML page."""

    def one(page: str | None) -> list[str]:
        found = re.search(r"chatMessages\s*=\s*\[", page or "")
        body = balanced(page, found.end() - 1) if found else None
        if not body:
            return []
        body = re.sub(r",\s*([\]}])", r"\1", re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', body))
        try:
            return [json.dumps(m, ensure_ascii=False) for m in json.loads(body)]
        except ValueError:
            return []

    return html.map(one)


def html_export(spark: SparkSession, html_path: str, csv_path: str, me: list[str]) -> DataFrame:
    """Messages of an HTML page joined with the CSV metadata on time, type and sender (last row of a key wins)."""
    pages = spark.read.text(html_path, wholetext=True)
    schema = "MsgSvrID string, type int, sub_type int, is_send int, timestamp long, text string, talker string"
    rows = pages.select(F.posexplode(html_messages("value")).alias("seq", "j")).select("seq", F.from_json("j", schema).alias("m")).select("seq", "m.*")
    meta = spark.read.option("header", True).option("multiLine", True).csv(csv_path).withColumn("__n", F.monotonically_increasing_id())
    key = F.concat_ws("_", "CreateTime", "Type", "IsSender")
    meta = meta.groupBy(key.alias("k")).agg(F.max_by("Sender", "__n").alias("sender"), F.max_by("localId", "__n").alias("local_id"))
    both = rows.withColumn("k", F.concat_ws("_", "timestamp", "type", "is_send")).join(meta, "k", "left").drop("k")
    speaker = F.when((F.col("is_send") == 1) | F.col("sender").isin(me), "ME").otherwise("OTHER")
    return both.select(F.concat(F.lit("P1:"), F.coalesce("MsgSvrID", F.col("seq").cast("string"))).alias("msg_uid"), F.col("timestamp").alias("ts"), speaker.alias("speaker"), "type", "sub_type", F.coalesce("text", F.lit("")).alias("text_raw"), "local_id", "seq")


def strip_html(html: str):
    """Text of a page as a column: scripts, styles, comments and tags out, basic entities decoded, space collapsed."""
    t = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def media_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, modified) of files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


#: Registered readers by name.
READERS = {"csv": mapped_csv, "jsonl": jsonl, "mapped_jsonl": mapped_jsonl, "telegram": telegram, "chat_text": chat_text, "html": html_export}


def reader(name: str):
    if name not in READERS:
        raise KeyError(f"no reader {name}; there are {', '.join(sorted(READERS))}")
    return READERS[name]
