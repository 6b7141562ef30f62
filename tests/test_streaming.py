"""Streams over bounded input against the same functions in batch."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from parley.operators import timeline
from parley.streaming import events, state


def test_sessions_equal_batch(spark, tmp_path, sf):
    source = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    source.orderBy("ts").coalesce(1).write.parquet(folder)
    end = source.agg(F.max("ts")).first()[0]
    stream = events.stream(spark, folder, source.schema)
    got = events.run_to_memory(events.sessions(stream, "user_id", "6 hours"), "sessions_out", checkpoint=str(tmp_path / "c")).collect()
    every = {(r.user_id, r.start, r.n): r.end for r in events.sessions(source, "user_id", "6 hours").collect()}
    found = {(r.user_id, r.start, r.n) for r in got}
    # sessions that end well before the watermark are out, none is that the batch lacks
    assert found <= set(every) and {k for k, e in every.items() if e < end - datetime.timedelta(hours=3)} <= found


def test_guarded_tokens(spark, tmp_path):
    rows = [(1, i, t, i == 5) for i, t in enumerate(["Hello ", "bad", " one. ", "A very long piece without any end", " x", "y"])]
    spark.createDataFrame(rows, "session_id long, seq long, token string, is_last boolean").coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("session_id long, seq long, token string, is_last boolean").parquet(str(tmp_path / "t"))
    with state.data_batches_only(spark):
        out = [r.piece for r in events.run_to_memory(state.guarded_tokens(stream, 16, banned={"bad": "***"}), "pieces").collect()]
    assert "".join(out).replace("***", "bad") == "".join(r[2] for r in rows) and out[0] == "Hello *** one." and all(len(p) <= 16 for p in out)


def test_last_turns_and_phases(spark, tmp_path):
    spark.createDataFrame([(1, i, f"t{i}") for i in range(5)], "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "v"))
    turns = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "v"))
    with state.data_batches_only(spark):
        assert {r.turn: r.context for r in events.run_to_memory(state.last_turns(turns, 2), "turns_out").collect()}[4] == "t3\nt4"
    spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 3)], "session_id long, phase string, seq long").coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("session_id long, phase string, seq long").parquet(str(tmp_path / "p"))
    with state.data_batches_only(spark):
        rows = events.run_to_memory(state.phases(stream, ["a", "b", "c"]), "phases_out")
    assert [r.phase for r in rows.orderBy("seq").collect()] == ["b", "c"]


MESSAGE = "conv_id long, seq long, ts timestamp, speaker string, modality string, text_raw string, emotion_tags array<string>, msg_uid string"


def messages(seed, n=300):
    rng, rows, at = random.Random(seed), [], {}
    for i in range(n):
        conv = rng.randrange(4)
        at[conv] = at.get(conv, 1_700_000_000) + rng.choice([1, 5, 20, 59, 61, 300])
        rows.append((conv, i, datetime.datetime.fromtimestamp(at[conv], datetime.timezone.utc).replace(tzinfo=None), rng.choice(["ME", "ME", "OTHER"]), rng.choice(["text"] * 8 + ["image"]), rng.choice(["hi", "ok!!", "a longer text", "", None]), rng.choice([[], [], ["x"]]), f"m{i}"))
    return rows


@pytest.mark.parametrize("bursts", [[], ["!!"]])
def test_islands_equal_batch(spark, tmp_path, bursts):
    rows = messages(3)
    batch = spark.createDataFrame(rows, MESSAGE).withColumn("ts", F.unix_timestamp("ts"))
    want = {(r.conv_id, r.seq, r.speaker, r.text_raw, r.merged_count, tuple(r.original_ids), r.ts, r.end_ts, tuple(r.emotion_tags)) for r in timeline.merge_messages(batch, bursts=bursts).collect()}
    rows.sort(key=lambda r: r[2])
    rng = random.Random(1)
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for i in range(1, len(parts)):  # some rows come a file late, within the watermark
        parts[i] += [parts[i - 1].pop() for _ in range(3)]
    end = max(r[2] for r in rows)
    far = [(9, 10**6, end + datetime.timedelta(days=1), "ME", "text", "end", [], "end")]
    late = [(0, 10**6 + 1, rows[0][2] - datetime.timedelta(days=1), "ME", "text", "late", [], "late")]
    for i, part in enumerate([*parts, far, late, far]):
        rng.shuffle(part)
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"islands_{len(bursts)}"
    query = state.islands(stream, late="1 hour", bursts=bursts).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.conv_id, r.seq, r.speaker, r.text_raw, r.merged_count, tuple(r.original_ids), r.ts, r.end_ts, tuple(r.emotion_tags)) for r in spark.table(name).collect()}
    assert got == want and state.late_rows(query) == 1


def test_idle_conversations_are_forgotten(spark, tmp_path):
    def run(rows, name):
        spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
        stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "v"))
        out = state.last_turns(stream, 3, idle=20_000)
        with state.data_batches_only(spark):
            sink = out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        sink.awaitTermination(60)
        return {(r.conv_id, r.turn): r.context for r in spark.read.parquet(str(tmp_path / "o")).collect()}

    run([(1, 1, "a"), (2, 1, "x")], "first")
    assert run([(1, 2, "b")], "second")[1, 2] == "a\nb"
    time.sleep(21)
    got = run([(1, 3, "c"), (2, 2, "y")], "third")
    assert got[1, 3] == "c" and got[2, 2] == "y"


def test_interrupts_hold_a_phase(spark, tmp_path):
    rows = [(1, "a", 1), (1, "interrupt", 2), (1, "b", 3), (1, "interrupt", 4), (1, "continue", 5), (1, "c", 6), (1, "b", 7), (2, "interrupt", 1), (2, "continue", 2), (2, "continue", 3), (2, "b", 4)]
    spark.createDataFrame(rows, "session_id long, phase string, seq long").coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("session_id long, phase string, seq long").parquet(str(tmp_path / "p"))
    with state.data_batches_only(spark):
        got = sorted((r.session_id, r.seq, r.phase) for r in events.run_to_memory(state.phases(stream, ["a", "b", "c"]), "held_out").collect())
    assert got == [(1, 1, "a"), (1, 2, "interrupted"), (1, 5, "a"), (1, 6, "c"), (2, 1, "interrupted"), (2, 4, "b")]
