"""The user's surface: ingest, enrichment, anonymisation, training tables, retrieval, arena and statistics as methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.times import epoch  # noqa: F401
from parley.operators import chunks, joins, messages, privacy, ranking, reports, retrieval, timeline
from parley.sources import datasets, files, sinks


class Engine:
    """All methods give DataFrames; nothing runs before the caller writes or collects them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def schema(self) -> DataFrame:
        """(column, type, required) of canonical messages."""
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.name in messages.REQUIRED) for f in messages.CANONICAL], "column string, type string, required boolean")

    def readers(self) -> list[str]:
        return sorted(files.READERS)

    def manifest_template(self) -> dict:
        return {"source_type": self.readers()[0], "input_paths": ["..."], "timezone": "Asia/Shanghai", "participants": {"name": "ME"}, "mapping": {"column": "text_raw"}}

    def read(self, manifest: datasets.Manifest) -> DataFrame:
        """Canonical messages of a manifest."""
        read, out = files.reader(manifest.source_type), None
        for path in manifest.input_paths:
            if manifest.source_type == "csv":
                rows = read(self.spark, path, manifest.mapping, "CSV", manifest.participants)
            elif manifest.source_type == "jsonl":
                rows = read(self.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in messages.CANONICAL))
            elif manifest.source_type == "mapped_jsonl":
                rows = read(self.spark, path, manifest.mapping, "JSONL", manifest.participants)
            elif manifest.source_type == "html":
                rows = read(self.spark, path, path.rsplit(".", 1)[0] + ".csv", [k for k, v in manifest.participants.items() if v == "ME"])
            else:
                rows = read(self.spark, path, manifest.participants)
            rows = messages.canonical(rows)
            out = rows if out is None else out.unionByName(rows)
        return out

    def ingest(self, manifest: datasets.Manifest) -> tuple[DataFrame, DataFrame]:
        """(valid messages by time, rejected ones with their errors)."""
        checked = messages.validate(self.read(manifest))
        return checked.where(F.size("errors") == 0).drop("errors").orderBy("ts", "msg_uid"), checked.where(F.size("errors") > 0)

    def dry_run(self, manifest: datasets.Manifest, rows: int = 100) -> DataFrame:
        """Coverage of each field in the first rows."""
        return reports.coverage(self.read(manifest).limit(rows))

    def report(self, rows: DataFrame) -> DataFrame:
        return reports.counts(rows.withColumn("date", F.to_date(F.timestamp_seconds("ts"))), ["modality", "speaker", "date"])

    def enrich(self, rows: DataFrame, artifacts: dict[str, DataFrame]) -> DataFrame:
        """Messages with the columns of their media artifacts, by msg_uid."""
        return joins.enrich(rows, "msg_uid", artifacts)

    def post_process(self, rows: DataFrame, mode: str = "islands") -> DataFrame:
        """Merged messages: mode islands or rapid_fire."""
        return timeline.merge_messages(rows) if mode == "islands" else timeline.merge_rapid_fire(rows)

    def anonymise(self, rows: DataFrame, level: int, names: dict[str, str]) -> DataFrame:
        """Level 1 or 2; times of level 2 are relative to the conversation's first."""
        out = privacy.level1(rows, names)
        return out if level == 1 else privacy.level2(out.join(out.groupBy("conv_id").agg(F.min("ts").alias("base")), "conv_id"), "base").drop("base")

    def training_rows(self, rows: DataFrame) -> DataFrame:
        return messages.trim_for_training(rows)

    def chunk(self, rows: DataFrame, n: int = 100, size: int = 20, step: int = 10, least: int = 10) -> DataFrame:
        """The n best windows with score and type; rows need conv_id, seq, ts, speaker, type, text, emotion_tags, break_type."""
        return chunks.top(chunks.score(timeline.hopping(rows, size, step, least), ["conv_id", "start"]), n, ["conv_id", "start"])

    def search(self, table: DataFrame, *, day: int | None = None, days: tuple[int, int] | None = None, words: list[str] = (), kind: str | None = None, k: int = 5) -> DataFrame:
        """Chunks (chunk_id, text, days, type) by day, else by a range of days, else by words; then by type; k rows."""
        if day is not None:
            found = retrieval.by_days(table, [day]).withColumn("score", F.lit(10.0))
        elif days is not None:
            found = retrieval.day_range(table, *days).withColumn("score", F.lit(10.0))
        else:
            found = table.withColumn("score", retrieval.overlap(list(words), "text")).where("score > 0")
        return ranking.top_k(retrieval.by_type(found, kind) if kind else found, k, "score", "chunk_id")

    def leaderboard(self, battles: DataFrame, mode: str | None = None) -> DataFrame:
        """Ratings with wins; only battles of the mode if one is given."""
        rows = battles.where(F.col("mode") == mode) if mode else battles
        won = F.when(F.col("vote") == "a_win", 1.0).when(F.col("vote") == "b_win", 0.0).otherwise(0.5)
        rated = ranking.bradley_terry(rows.select("model_a", "model_b", won.alias("wins_a"), (1 - won).alias("wins_b")))
        return rated.join(reports.wins(rows), "model").orderBy(F.desc("rating"), "model")

    def sizes(self, tables: dict[str, DataFrame | None]) -> DataFrame:
        """(name, n): rows by table, 0 for missing ones."""
        out = self.spark.createDataFrame([(n, 0) for n, t in tables.items() if t is None], "name string, n long")
        for name, t in tables.items():
            if t is not None:
                out = out.union(t.agg(F.count("*").alias("n")).select(F.lit(name), "n"))
        return out

    def export(self, rows: DataFrame, folder: str) -> None:
        """JSON lines, CSV and Markdown by day."""
        sinks.jsonl(rows, f"{folder}/jsonl")
        sinks.csv(sinks.export_rows(rows.withColumn("local_id", F.lit(None).cast("string")).withColumn("seq", F.monotonically_increasing_id())), f"{folder}/csv")
        sinks.markdown_days(rows.withColumn("seq", F.monotonically_increasing_id())).write.mode("overwrite").partitionBy("date").text(f"{folder}/markdown")
