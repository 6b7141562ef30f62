"""Further sources: dialogue sets, knowledge files, traces, sessions, documents, media pairs, generated messages, a connector."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parley.operators.messages import map_code

ROLES = {"client": "ME", "user": "ME", "human": "ME", "counselor": "OTHER", "assistant": "OTHER", "gpt": "OTHER"}


def dialogues(spark: SparkSession, path: str, source: str, items: str = "messages", role: str = "role", content: str = "content", multiline: bool = False) -> DataFrame:
    """(source, conversation): lines `ME: ...` and `OTHER: ...` of each dialogue; roles that are not known are left out."""
    rows = spark.read.schema(f"`{items}` array<struct<`{role}`: string, `{content}`: string>>").option("multiLine", multiline).json(path)
    named = F.transform(items, lambda m: F.struct(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.lower(m[role])).alias("r"), m[content].alias("c")))
    lines = F.transform(F.filter(named, lambda m: m["r"].isNotNull()), lambda m: F.concat(m["r"], F.lit(": "), F.coalesce(m["c"], F.lit(""))))
    return rows.select(F.lit(source).alias("source"), F.array_join(lines, "\n").alias("conversation")).where("conversation <> ''")


KNOWLEDGE = "id string, question string, answer string, category string, keywords array<string>, evidence_tier string, risk_level string, related array<string>, evidence_note string, source string, license string, review_status string, reviewed_by string, review_date string, domain string"


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all JSON-lines files below a folder, with `file`; malformed lines are left out."""
    rows = spark.read.schema(KNOWLEDGE + ", _bad string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file")).where("_bad is null").drop("_bad")


def knowledge_problems(entries: DataFrame, categories: list[str], tiers: list[str], banned: str) -> DataFrame:
    """(id, problems): missing fields, values outside the lists, red-zone wording, licences that are not free, duplicate ids."""
    twice = F.col("n") > 1
    n = entries.groupBy("id").agg(F.count("*").alias("n"))
    checks = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing:{c}")) for c in ("id", "question", "answer", "category")]
    checks += [F.when(~F.col("category").isin(categories), F.lit("category")), F.when(~F.col("evidence_tier").isin(tiers), F.lit("evidence_tier")), F.when(F.concat_ws(" ", "question", "answer").rlike(banned), F.lit("wording"))]
    checks += [F.when(F.lower(F.coalesce("license", F.lit(""))).rlike("proprietary|all rights reserved"), F.lit("license")), F.when(twice, F.lit("duplicate"))]
    return entries.join(n, "id", "left").select("id", F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("problems"))


def traces(spark: SparkSession, folder: str, run: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/{run}/*.jsonl").withColumn("file", F.col("_metadata.file_path"))


def sessions(spark: SparkSession, folder: str, schema: str, date: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Session documents, one per file, between two dates inclusive; undated ones are kept. `modified` tells the file's time."""
    rows = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("modified", F.col("_metadata.file_modification_time"))
    day = F.to_date(date)
    keep = F.lit(True)
    if since:
        keep = keep & (day >= F.lit(since).cast("date"))
    if until:
        keep = keep & (day <= F.lit(until).cast("date"))
    return rows.where(day.isNull() | keep)


def audit(spark: SparkSession, folder: str, schema: str, wanted: DataFrame, days: tuple[str, str] | None = None) -> DataFrame:
    """Audit events of wanted sessions; day folders outside the range are not read."""
    rows = spark.read.schema(schema + ", day string").parquet(folder)
    if days:
        rows = rows.where(F.col("day").between(*days))
    return rows.join(wanted.select("session_id"), "session_id", "left_semi")


def newest(rows: DataFrame, status: Column, k: int | None = None) -> DataFrame:
    """Sessions with their status, newest first."""
    out = rows.withColumn("status", status).orderBy(F.desc("modified"), "session_id")
    return out if k is None else out.limit(k)


def document_texts(spark: SparkSession, path: str, chars: int = 2000, members: int = 50) -> DataFrame:
    """(path, kind, text): beginning of text and Word files, member list of archives; others have a null text."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p, content in zip(frame.path, frame.content):
                kind, text = p.rpartition(".")[2].lower(), None
                try:
                    if kind in ("txt", "md"):
                        text = content.decode("utf-8", "replace")[:chars]
                    elif kind == "docx":
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            xml = z.read("word/document.xml").decode("utf-8")
                        text = re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", xml)).strip()[:chars]
                    elif kind == "zip":
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            text = "\n".join(z.namelist()[:members])
                except (zipfile.BadZipFile, KeyError):
                    text = None
                out.append((p, kind, text))
            yield pd.DataFrame(out, columns=["path", "kind", "text"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(read, "path string, kind string, text string")


def file_pairs(names: list[str]) -> tuple[str | None, str | None]:
    """The first HTML file and the CSV of the same stem, else the first CSV."""
    html = next((n for n in sorted(names) if n.lower().endswith(".html")), None)
    csvs = [n for n in sorted(names) if n.lower().endswith(".csv")]
    same = next((n for n in csvs if html and n.rsplit(".", 1)[0] == html.rsplit(".", 1)[0]), None)
    return html, same or (csvs[0] if csvs else None)


def source_type(names: list[str]) -> str | None:
    """Reader for the files of a folder; None if none fits."""
    ends = {n.rpartition(".")[2].lower() for n in names}
    if {"html", "csv"} <= ends:
        return "html"
    if "result.json" in names:
        return "telegram"
    return "chat_text" if "txt" in ends else "jsonl" if "jsonl" in ends else "csv" if "csv" in ends else None


@dataclass
class Manifest:
    """What to ingest and how."""

    source_type: str
    input_paths: list[str]
    timezone: str = "Asia/Shanghai"
    participants: dict[str, str] = field(default_factory=dict)
    mapping: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def read(values: dict) -> "Manifest":
        missing = [k for k in ("source_type", "input_paths") if not values.get(k)]
        if missing:
            raise ValueError(f"manifest lacks {', '.join(missing)}")
        return Manifest(**{k: v for k, v in values.items() if k in Manifest.__dataclass_fields__})


#: Template of generated messages: minutes after the one before, speaker, modality, text.
ARC = [(0, "ME", "text", "good morning"), (2, "OTHER", "text", "morning, how are you"), (1, "ME", "image", "photo of breakfast"), (30, "OTHER", "voice", "voice note"), (200, "ME", "text", "are you busy"), (1, "ME", "sticker", "waiting"), (45, "OTHER", "text", "sorry, long meeting")]


def generated(arcs: DataFrame, arc_minutes: int = 1440) -> DataFrame:
    """The template once for each of `arcs` (id, start in seconds), `arc_minutes` later for each id; made by the tasks."""
    minutes = [sum(a[0] for a in ARC[: i + 1]) for i in range(len(ARC))]
    template = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("minute"), F.lit(s).alias("speaker"), F.lit(k).alias("modality"), F.lit(t).alias("text_raw")) for i, (m, (_, s, k, t)) in enumerate(zip(minutes, ARC))])
    rows = arcs.select("id", "start", F.explode(template).alias("m")).select("id", "start", "m.*")
    return rows.select(F.concat(F.lit("GEN:"), F.col("id") * len(ARC) + F.col("i")).alias("msg_uid"), (F.col("start") + (F.col("id") * arc_minutes + F.col("minute")) * 60).alias("ts"), "speaker", F.lit(1).alias("type"), "modality", "text_raw", (F.col("id") * len(ARC) + F.col("i")).alias("seq"))


class _Part(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class MessageSource(DataSource):
    """A connector as a Python data source: subclasses give rows of a range. Option `rows` is their number, `parts` the tasks."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return "msg_uid string, ts bigint, speaker string, type int, modality string, text_raw string"

    def reader(self, schema):
        return _MessageReader(self.options)


class _MessageReader(DataSourceReader):
    def __init__(self, options):
        self.rows, self.parts = int(options.get("rows", "0")), int(options.get("parts", "2"))

    def partitions(self):
        step = -(-self.rows // self.parts) if self.rows else 1
        return [_Part(i, min(i + step, self.rows)) for i in range(0, self.rows, step)]

    def read(self, partition):
        for i in range(partition.first, partition.end):
            _, speaker, modality, text = ARC[i % len(ARC)]
            yield f"SRC:{i}", 1_700_000_000 + 60 * i, speaker, 1, modality, text


def normalise_raw(df: DataFrame, codes: dict[int, str], me: list[str]) -> DataFrame:
    """Raw export rows (seq, type, sub_type, is_send, ts, text, sender) as canonical ones: speaker, modality, unescaped text."""
    text = F.coalesce("text", F.lit(""))
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    kinds = {str(k): v for k, v in codes.items()}
    keyed = df.withColumn("__t", F.col("type").cast("string"))
    speaker = F.when((F.col("is_send") == 1) | F.col("sender").isin(me), "ME").otherwise("OTHER")
    return keyed.select("seq", "ts", "type", "sub_type", speaker.alias("speaker"), map_code("__t", kinds, "unknown").alias("modality"), text.alias("text_raw"), F.from_unixtime("ts").alias("time_local"))
