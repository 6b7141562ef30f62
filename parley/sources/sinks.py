"""Writers. Rows are formatted by expressions and written by the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.times import format_epoch

LEDGER = ["id", "category", "domain", "question", "evidence_tier", "risk_level", "source", "license", "review_status", "reviewed_by", "review_date", "evidence_note"]


def jsonl(df: DataFrame, path: str, compact: bool = True) -> None:
    """One JSON object per row; null fields are left out when compact."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(compact).lower()}).alias("value")).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_rows(messages: DataFrame) -> DataFrame:
    """The columns of a message export; localId falls back to the row's seq."""
    me = F.col("speaker") == "ME"
    return messages.select(
        F.coalesce("local_id", F.col("seq").cast("string")).alias("localId"), F.when(me, "1").otherwise("2").alias("TalkerId"), F.col("type").alias("Type"), F.col("sub_type").alias("SubType"),
        me.cast("int").alias("IsSender"), F.col("ts").alias("CreateTime"), F.lit("").alias("Status"), F.col("text_raw").alias("StrContent"), format_epoch("ts", "yyyy-MM-dd HH:mm:ss", "1970-01-01 00:00:00").alias("StrTime"),
        F.lit("").alias("Remark"), F.col("speaker").alias("NickName"), F.col("speaker").alias("Sender"),
    )


def markdown_days(messages: DataFrame) -> DataFrame:
    """(date, body): lines `**time name**: text` of each day in order."""
    line = F.concat(F.lit("**"), format_epoch("ts", "HH:mm:ss", "00:00:00"), F.lit(" "), F.regexp_replace("speaker", "^OTHER:", ""), F.lit("**: "), F.coalesce("text_raw", F.lit("")))
    rows = messages.select(format_epoch("ts", "yyyy-MM-dd", "1970-01-01").alias("date"), "ts", "seq", line.alias("line"))
    day = rows.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "line"))).alias("l"))
    return day.select("date", F.concat(F.lit("## "), F.col("date"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("body"))


def html_page(messages: DataFrame) -> DataFrame:
    """(value): one page with the array `chatMessages`; for exports of one conversation."""
    m = F.to_json(F.struct(F.col("msg_uid").alias("MsgSvrID"), "type", "sub_type", (F.col("speaker") == "ME").cast("int").alias("is_send"), F.col("ts").alias("timestamp"), F.col("text_raw").alias("text")))
    rows = messages.agg(F.sort_array(F.collect_list(F.struct("ts", "seq", m.alias("m")))).alias("l"))
    return rows.select(F.concat(F.lit("<html><body><script>var chatMessages = [\n"), F.array_join(F.transform("l", lambda x: x["m"]), ",\n"), F.lit("\n];</script></body></html>")).alias("value"))


def ledger(knowledge: DataFrame) -> DataFrame:
    """The ledger columns of knowledge rows, as text, empty where missing."""
    return knowledge.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in knowledge.columns else F.lit("")).alias(c) for c in LEDGER])


def media_target(modality: str, ts: str, name: str) -> Column:
    """modality[/YYYY-MM]/name, the month for images and videos."""
    month = F.when(F.col(modality).isin("image", "video") & (F.col(ts) > 0), F.concat(F.date_format(F.timestamp_seconds(F.col(ts)), "yyyy-MM"), F.lit("/"))).otherwise(F.lit(""))
    return F.concat(F.col(modality), F.lit("/"), month, F.col(name))


def distinct_targets(files: DataFrame, target: str, sha: str) -> DataFrame:
    """files with `final`: equal content shares a target; other content of one name gets the hash's first 8 characters.

    files must have `order`, which decides who keeps the plain name.
    """
    first = files.groupBy(target).agg(F.min_by(sha, "order").alias("__first"))
    stem, ext = F.regexp_extract(target, "^(.*?)(\\.[^./]*)?$", 1), F.regexp_extract(target, "(\\.[^./]*)$", 1)
    return files.join(first, target).withColumn("final", F.when(F.col(sha) == F.col("__first"), F.col(target)).otherwise(F.concat(stem, F.lit("_"), F.left(F.col(sha), F.lit(8)), ext))).drop("__first")
