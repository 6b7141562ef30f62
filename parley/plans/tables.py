"""The supplied tables in the shapes that the operators take."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.times import epoch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: user is ME, assistant OTHER, one turn a minute."""
    c = table(spark, sf_dir, "conversations")
    speaker = F.when(F.col("role") == "user", "ME").when(F.col("role") == "assistant", "OTHER").otherwise("SYSTEM")
    return c.select(
        "conv_id", F.col("turn").alias("seq"), (F.lit(1700000000) + F.col("conv_id") * 86400 + F.col("turn") * 60).alias("ts"), speaker.alias("speaker"), F.lit("text").alias("modality"),
        F.col("text").alias("text_raw"), F.array().cast("array<string>").alias("emotion_tags"), F.concat(F.lit("CV:"), "conv_id", F.lit("-"), "turn").alias("msg_uid"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages: the user is the conversation, the event type the speaker."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("seq"), epoch("ts").alias("ts"), F.col("event_type").alias("speaker"), F.lit("text").alias("modality"),
        F.concat(F.col("event_type"), F.lit(" "), F.get_json_object("props", "$.k")).alias("text_raw"), F.array().cast("array<string>").alias("emotion_tags"),
        F.concat(F.lit("EV:"), "event_id").alias("msg_uid"), "value", F.col("ts").alias("time"),
    )


#: The same shapes in SQL.
TURNS = """turns AS (
  SELECT conv_id, turn AS seq, 1700000000 + conv_id * 86400 + turn * 60 AS ts,
         CASE role WHEN 'user' THEN 'ME' WHEN 'assistant' THEN 'OTHER' ELSE 'SYSTEM' END AS speaker, text AS text_raw, 'CV:' || conv_id || '-' || turn AS msg_uid FROM conversations)"""
EVENT_ROWS = """ev AS (
  SELECT user_id AS conv_id, event_id AS seq, epoch_us(ts) // 1000000 AS ts, event_type AS speaker, event_type || ' ' || (props::JSON->>'$.k') AS text_raw, value, ts AS time FROM events)"""


@functools.cache
def _local_folder() -> str:
    """A folder of this process, deleted when it ends."""
    folder = tempfile.mkdtemp(prefix="parley-files-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; in local mode without that setting a temporary one."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = f"file://{_local_folder()}"
    return f"{have.rstrip('/')}/{name}-{uuid.uuid4().hex}"
