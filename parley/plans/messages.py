"""Queries over conversations and events: validation, timelines, chunks, reports on messages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import times
from parley.operators import chunks, joins, messages, privacy, reports, timeline
from parley.plans.catalogue import query
from parley.plans.tables import EVENT_ROWS, TURNS, event_rows, table, turns

#: Words of the corpus that stand for sentiment and labels here.
BAD, GOOD = ["trash", "idiot", "nicht"], ["the", "und", "que"]
LABELS = {"articles": ["the ", "der ", "les "], "prepositions": [" of ", " von ", " dans "], "conjunctions": [" and ", " und ", " et "], "relatives": ["that", "dass", "que"]}


def _present(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"(contains(coalesce({c}, ''), '{w}'))::INT" for w in words) + ")"


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(coalesce({c}, ''), '{w}')" for w in words) + ")"


@query(f"""WITH {TURNS}, g AS (
  SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND ts - lag(ts) OVER w <= 60 THEN 0 ELSE 1 END AS n FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY ts, seq)
), i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT conv_id, island::BIGINT AS island, min(ts) AS ts, any_value(speaker) AS speaker, count(*)::BIGINT AS merged_count, max(ts) AS end_ts, sum(length(text_raw))::BIGINT AS chars FROM i GROUP BY conv_id, island""")
def islands_merge(spark, sf_dir):
    """Neighbouring turns of one speaker within a minute are one message."""
    rows = messages.validate(turns(spark, sf_dir).withColumn("type", F.lit(1))).where(F.size("errors") <= 1)
    w = timeline.by()
    breaks = ~((F.col("speaker") == F.lag("speaker").over(w)) & (F.col("ts") - F.lag("ts").over(w) <= 60))
    return timeline.island_ids(rows, breaks).groupBy("conv_id", F.col("island").cast("long").alias("island")).agg(F.min("ts").alias("ts"), F.first("speaker").alias("speaker"), F.count("*").alias("merged_count"), F.max("ts").alias("end_ts"), F.sum(F.length("text_raw")).alias("chars"))


@query(f"""WITH {EVENT_ROWS}, g AS (
  SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND ts - lag(ts) OVER w <= 21600 THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY conv_id ORDER BY ts, seq)
), i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT conv_id, island::BIGINT AS island, min(ts) AS ts, min(speaker) AS speaker, CASE WHEN bool_short THEN string_agg(text_raw, ' ' ORDER BY ts, seq) ELSE string_agg(text_raw, chr(10) ORDER BY ts, seq) END AS text_raw, count(*)::INT AS merged_count, max(ts) AS end_ts
FROM (SELECT *, bool_and(length(text_raw) < 10) OVER (PARTITION BY conv_id, island) AS bool_short FROM i) GROUP BY conv_id, island, bool_short""")
def event_islands(spark, sf_dir):
    """Events of one type within six hours merged, texts joined in order."""
    out = timeline.merge_messages(event_rows(spark, sf_dir), within=21600)
    return out.select("conv_id", F.col("island").cast("long").alias("island"), "ts", "speaker", "text_raw", "merged_count", "end_ts")


@query(f"""WITH {EVENT_ROWS}, g AS (SELECT *, lag(ts) OVER w AS b_ts, lag(speaker) OVER w AS b_speaker FROM ev WINDOW w AS (PARTITION BY conv_id ORDER BY ts, seq)),
h AS (SELECT *, ts - b_ts AS gap FROM g WHERE ts - b_ts >= 7200)
SELECT conv_id, 'TIME_GAP_' || b_ts || '_' || ts AS msg_uid, b_ts + gap // 2 AS ts, gap AS gap_seconds,
  CASE WHEN gap < 86400 THEN (gap // 3600) || '小时' || CASE WHEN gap % 3600 // 60 > 0 THEN (gap % 3600 // 60) || '分钟' ELSE '' END
       ELSE (gap // 86400) || '天' || CASE WHEN gap % 86400 // 3600 > 0 THEN (gap % 86400 // 3600) || '小时' ELSE '' END END AS gap_description,
  CASE WHEN b_ts // 86400 <> ts // 86400 THEN 'day_change' ELSE 'normal_gap' END AS break_type, b_speaker AS before_speaker, speaker AS after_speaker FROM h""")
def time_gap_rows(spark, sf_dir):
    """Marker rows for gaps of two hours or more."""
    return timeline.gap_rows(event_rows(spark, sf_dir)).drop("speaker").withColumn("ts", F.col("ts").cast("long"))


@query(f"""WITH {TURNS}, g AS (SELECT *, lag(speaker) OVER w AS b, ts - lag(ts) OVER w AS seconds FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY ts, seq)), a AS (SELECT * FROM g WHERE speaker <> b)
SELECT conv_id, avg(seconds) FILTER (speaker = 'ME') AS me_avg, max(seconds) FILTER (speaker = 'ME') AS me_max, avg(seconds) FILTER (speaker = 'OTHER') AS other_avg, max(seconds) FILTER (speaker = 'OTHER') AS other_max,
  (avg(seconds) FILTER (speaker = 'OTHER') - avg(seconds) FILTER (speaker = 'ME')) / nullif(greatest(avg(seconds) FILTER (speaker = 'ME'), avg(seconds) FILTER (speaker = 'OTHER')), 0) AS asymmetry FROM a GROUP BY conv_id""")
def response_time(spark, sf_dir):
    """Response times by side."""
    return reports.response_stats(timeline.response_times(turns(spark, sf_dir)), ["conv_id"])


@query(f"""WITH {EVENT_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM ev),
s AS (SELECT conv_id, n.n, unnest(range(0, n.n - 9, 10)) AS start FROM (SELECT DISTINCT conv_id, n FROM n) n)
SELECT n.conv_id, s.start::BIGINT AS start, count(*)::BIGINT AS messages, min(ts) AS first_ts, max(ts) AS last_ts FROM n JOIN s ON s.conv_id = n.conv_id AND n.i >= s.start AND n.i < s.start + 20 GROUP BY ALL""")
def hopping_chunks(spark, sf_dir):
    """Windows of 20 rows every 10 rows, 10 rows at least."""
    return timeline.hopping(event_rows(spark, sf_dir)).groupBy("conv_id", F.col("start").cast("long").alias("start")).agg(F.count("*").alias("messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {TURNS}, n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY ts, seq) - 1) // 4 AS block FROM turns)
SELECT conv_id, block::BIGINT AS block, string_agg(speaker || ': ' || text_raw, chr(10) ORDER BY seq) AS document, min(ts) AS start_ts, max(ts) AS end_ts, count(*)::BIGINT AS n FROM n GROUP BY conv_id, block""")
def tumbling_docs(spark, sf_dir):
    """Documents of four turns."""
    rows = timeline.tumbling(turns(spark, sf_dir), 4)
    lines = F.sort_array(F.collect_list(F.struct("seq", F.concat("speaker", F.lit(": "), "text_raw").alias("l"))))
    return rows.groupBy("conv_id", "block").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("document"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))


@query("SELECT event_type, row_number() OVER (ORDER BY min(event_id), event_type)::INT AS id FROM events GROUP BY event_type")
def dense_id(spark, sf_dir):
    """Ids in order of first occurrence."""
    return timeline.dense_ids(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(f"""WITH {EVENT_ROWS} SELECT conv_id, seq, CASE WHEN time::DATE = lag(time::DATE) OVER (PARTITION BY conv_id ORDER BY ts, seq) THEN strftime(time, '%H:%M') ELSE strftime(time, '%Y-%m-%d %H:%M') END AS short_time FROM ev""")
def time_compress(spark, sf_dir):
    """The date only where it changes."""
    return timeline.compress_times(event_rows(spark, sf_dir), order=("ts", "seq")).select("conv_id", "seq", "short_time")


@query(f"""WITH {EVENT_ROWS} SELECT conv_id, seq, lead(value, 2) OVER (PARTITION BY conv_id ORDER BY seq) - value AS delta FROM ev""")
def proximal_lead(spark, sf_dir):
    """The change two rows later."""
    return timeline.later_change(event_rows(spark, sf_dir), "value", 2, "conv_id", "seq").select("conv_id", "seq", "delta")


@query(f"""WITH {EVENT_ROWS}, l AS (SELECT *, CASE WHEN value > 80 THEN 'ORANGE' WHEN value > 50 THEN 'YELLOW' ELSE 'GREEN' END AS level FROM ev),
c AS (SELECT *, sum((level = 'ORANGE')::INT) OVER w AS o, sum((level = 'YELLOW')::INT) OVER w AS y FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY ts, seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT conv_id, seq, CASE WHEN o >= 2 THEN 'RED' WHEN y >= 3 THEN 'ORANGE' WHEN y >= 2 THEN 'YELLOW' ELSE 'GREEN' END AS escalated FROM c""")
def rolling_escalation(spark, sf_dir):
    """Levels over the three rows before."""
    rows = event_rows(spark, sf_dir).withColumn("level", F.when(F.col("value") > 80, "ORANGE").when(F.col("value") > 50, "YELLOW").otherwise("GREEN"))
    return timeline.escalation(rows, "level").select("conv_id", "seq", "escalated")


@query(f"""WITH {TURNS}, r AS (SELECT conv_id, seq, row_number() OVER w AS rank, sum(length(text_raw)) OVER (PARTITION BY conv_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS used FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY seq DESC))
SELECT conv_id, seq, rank::INT AS rank, used::BIGINT AS used FROM r WHERE used <= 600""")
def budget_running_sum(spark, sf_dir):
    """Latest turns within 600 characters."""
    return timeline.within_budget(turns(spark, sf_dir).withColumn("chars", F.length("text_raw")), "chars", 600).select("conv_id", "seq", "rank", "used")


@query(f"""WITH {EVENT_ROWS} SELECT conv_id, seq, (SELECT count(*) FROM ev b WHERE b.conv_id = a.conv_id AND b.ts BETWEEN a.ts - 3599 AND a.ts) AS recent FROM ev a""")
def rate_window(spark, sf_dir):
    """Q04: events of the user in the hour up to each event."""
    return timeline.rate(event_rows(spark, sf_dir), 3600, "conv_id", "ts").select("conv_id", "seq", "recent")


@query(f"""WITH {EVENT_ROWS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < 21600 THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY conv_id ORDER BY ts, seq)),
i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT conv_id, island::BIGINT AS island, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n FROM i GROUP BY conv_id, island""")
def gap_sessions(spark, sf_dir):
    """G11 by gap: sessions that end after six hours."""
    return timeline.sessions(event_rows(spark, sf_dir), 21600).groupBy("conv_id", F.col("island").cast("long").alias("island")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {EVENT_ROWS}, o AS (SELECT conv_id, seq, row_number() OVER w AS rn, coalesce(ts - lag(ts) OVER w >= 21600 OR abs((value - 50) / 50 - (lag(value) OVER w - 50) / 50) >= 0.5, false) AS brk FROM ev WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
f AS (SELECT conv_id, seq, rn, 1 AS len, 0 AS seg FROM o WHERE rn = 1
  UNION ALL SELECT o.conv_id, o.seq, o.rn, CASE WHEN f.len >= 10 OR f.len >= 5 AND o.brk THEN 1 ELSE f.len + 1 END, f.seg + (f.len >= 10 OR f.len >= 5 AND o.brk)::INT FROM f JOIN o ON o.conv_id = f.conv_id AND o.rn = f.rn + 1),
z AS (SELECT conv_id, seg, count(*) AS n, max(seg) OVER (PARTITION BY conv_id) AS last FROM f GROUP BY conv_id, seg), y AS (SELECT *, lag(n) OVER (PARTITION BY conv_id ORDER BY seg) AS before FROM z),
t AS (SELECT f.conv_id, f.seq, CASE WHEN f.seg = y.last AND y.n < 5 THEN CASE WHEN y.before + y.n <= 10 THEN f.seg - 1 END ELSE f.seg END AS segment FROM f JOIN y ON y.conv_id = f.conv_id AND y.seg = f.seg)
SELECT conv_id, segment::BIGINT AS segment, count(*) AS n, min(seq) AS first_seq FROM t GROUP BY conv_id, segment""")
def event_segments(spark, sf_dir):
    """Splits that depend on the length so far."""
    rows = event_rows(spark, sf_dir).withColumn("sentiment", (F.col("value") - 50) / 50)
    return timeline.segment_by_events(rows.select("conv_id", "seq", "ts", "sentiment"), 5, 10, 21600, 0.5).groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(f"""WITH {EVENT_ROWS}, r AS (SELECT *, length(text_raw) <= 20 AS short, regexp_matches(text_raw, '[!！?？]{{2,}}') AS burst FROM ev), b AS (SELECT *, ts - lag(ts) OVER w AS gap, lag(speaker) OVER w = speaker AND NOT burst AND NOT lag(burst) OVER w AS same FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
a AS (SELECT *, coalesce(same AND gap <= 21600, false) AS able FROM b), q AS (SELECT *, able AND short AND gap <= 3600 AS quick FROM a),
c AS (SELECT *, last_value(CASE WHEN NOT able THEN short WHEN NOT quick THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS calm FROM q),
g AS (SELECT *, sum((NOT (able AND NOT (quick AND calm)))::INT) OVER (PARTITION BY conv_id ORDER BY seq) AS g FROM c) SELECT conv_id, min(seq) AS seq, count(*)::INT AS merged_count FROM g GROUP BY conv_id, g""")
def rapid_fire_merge(spark, sf_dir):
    """The merge variant with a rule over the open group."""
    return timeline.merge_rapid_fire(event_rows(spark, sf_dir), within=21600, rapid=3600).select("conv_id", "seq", "merged_count")


@query(f"""WITH {TURNS}, k AS (SELECT conv_id, seq, speaker, length(text_raw) AS l, {_present('text_raw', BAD)} AS bad, {_present('text_raw', GOOD)} AS good FROM turns),
g AS (SELECT conv_id, sum(bad) AS negative, sum(good) AS positive, sum(l) AS chars, var_pop(l) AS v, count(*) FILTER (speaker = 'ME') AS me, count(*) FILTER (speaker = 'OTHER') AS other, count(*) AS messages FROM k GROUP BY conv_id),
t AS (SELECT *, CASE WHEN negative > positive AND negative >= 3 THEN 'conflict' WHEN positive > negative AND positive >= 3 THEN 'sweet' ELSE 'normal' END AS chunk_type FROM g)
SELECT conv_id, negative::BIGINT AS negative, positive::BIGINT AS positive, messages, chunk_type,
  (0.25 * (1 - abs(me - other) / greatest(me + other, 1)) + 0.15 * least(v / 1000, 1) + 0.20 * least(negative / 5, 1) + 0.15 * least(positive / 5, 1) + 0.10 * least(chars / 500, 1)) * CASE chunk_type WHEN 'conflict' THEN 1.5 WHEN 'sweet' THEN 1.3 ELSE 1.0 END AS score FROM t""")
def chunk_score(spark, sf_dir):
    """Score and type of each conversation."""
    rows = turns(spark, sf_dir).select("conv_id", "speaker", F.lit("text").alias("type"), F.col("text_raw").alias("text"), "emotion_tags", F.lit(None).cast("string").alias("break_type"))
    return chunks.score(rows, ["conv_id"], BAD, GOOD)


@query("""WITH c AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS score FROM conversations GROUP BY conv_id)
SELECT conv_id, score::BIGINT AS score, 'chunk_' || lpad((row_number() OVER (ORDER BY score DESC, conv_id))::VARCHAR, 4, '0') AS chunk_id FROM c ORDER BY score DESC, conv_id LIMIT 20""")
def chunk_topn(spark, sf_dir):
    """The 20 longest conversations, numbered."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("score"))
    return chunks.top(c, 20, ["conv_id"])


@query("""WITH c AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY conv_id)
SELECT * FROM (SELECT conv_id, n, chars::BIGINT AS chars, 'longest' AS pick FROM c ORDER BY chars DESC, conv_id LIMIT 1) UNION ALL SELECT * FROM (SELECT conv_id, n, chars::BIGINT, 'most_turns' FROM c ORDER BY n DESC, conv_id LIMIT 1)
UNION ALL SELECT * FROM (SELECT conv_id, n, chars::BIGINT, 'short' FROM c WHERE n <= 2 ORDER BY conv_id LIMIT 1)""")
def representative_pick(spark, sf_dir):
    """One conversation per pick."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return chunks.representatives(c, {"longest": (F.lit(True), [F.desc("chars"), F.col("conv_id")]), "most_turns": (F.lit(True), [F.desc("n"), F.col("conv_id")]), "short": (F.col("n") <= 2, [F.col("conv_id")])})


@query("""WITH s AS (SELECT *, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS p FROM labels),
c AS (SELECT *, greatest(1, round(n * 0.8))::INT AS c1 FROM s), d AS (SELECT *, least(n - 1, c1 + greatest(1, round(n * 0.1))::INT) AS c2 FROM c)
SELECT quality, CASE WHEN n < 3 OR p <= least(c1, n - 2) THEN 'train' WHEN p <= greatest(c2, least(c1, n - 2) + 1) THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM d GROUP BY ALL""")
def stratified_split(spark, sf_dir):
    """Split by quality, counted."""
    return chunks.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality").groupBy("quality", "split").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN ('0x' || substr(sha256('7|run1|' || conv_id || '|' || turn), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE < 0.5 THEN 'prompt' ELSE 'no_prompt' END AS arm FROM conversations")
def deterministic_arm(spark, sf_dir):
    """Arm by hash."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chunks.arm("7", "run1", F.col("conv_id"), F.col("turn"), 0.5).alias("arm"))


@query("""SELECT user_id AS conv_id, count(*) FILTER (event_type = 'click')::BIGINT AS sticker, count(*) FILTER (event_type = 'view')::BIGINT AS image, count(*) FILTER (event_type = 'purchase')::BIGINT AS voice, count(*)::BIGINT AS total_messages,
round(count(*) FILTER (event_type IN ('click', 'view', 'purchase')) / greatest(count(*), 1), 3) AS density FROM events GROUP BY user_id""")
def mm_density(spark, sf_dir):
    """share of multimodal rows by user."""
    kinds = messages.map_code("event_type", {"click": "sticker", "view": "image", "purchase": "voice"}, "text")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), kinds.alias("type"))
    return chunks.density(rows, ["conv_id"]).select("conv_id", "sticker", "image", "voice", "total_messages", "density")


@query("""SELECT conv_id, turn, list_filter([CASE WHEN role NOT IN ('user', 'assistant') THEN 'speaker' END, CASE WHEN turn = 0 THEN 'ts' END], lambda x: x IS NOT NULL) AS errors FROM conversations""")
def canonical_validate(spark, sf_dir):
    """Error codes of each message."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.concat("conv_id", F.lit("-"), "turn").alias("msg_uid"), F.col("turn").alias("ts"), F.when(F.col("role") == "user", "ME").when(F.col("role") == "assistant", "OTHER").otherwise(F.col("role")).alias("speaker"), F.lit(1).alias("type"), F.lit("text").alias("modality"), F.col("text").alias("text_raw"))
    return messages.validate(rows).select("conv_id", "turn", F.array_sort("errors", lambda a, b: F.when(a > b, 1).when(a < b, -1).otherwise(0)).alias("errors"))


@query("SELECT error, n FROM (SELECT 'speaker' AS error, count(*) FILTER (role NOT IN ('user', 'assistant')) AS n FROM conversations UNION ALL SELECT 'ts', count(*) FILTER (turn = 0) FROM conversations) WHERE n > 0")
def error_histogram(spark, sf_dir):
    """how often each error occurs."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.concat("conv_id", F.lit("-"), "turn").alias("msg_uid"), F.col("turn").alias("ts"), F.when(F.col("role") == "user", "ME").when(F.col("role") == "assistant", "OTHER").otherwise(F.col("role")).alias("speaker"), F.lit(1).alias("type"), F.lit("text").alias("modality"), F.col("text").alias("text_raw"))
    return messages.error_report(rows)


@query("""SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY ALL UNION ALL SELECT 'total', '', count(*) FROM events""")
def ingest_report(spark, sf_dir):
    """counts by type and day and in all, over one scan."""
    e = table(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return reports.counts(e, ["event_type", "day"])


@query("""SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS period,
CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, printf('%02d-%02d', hour(ts) // 3 * 3, hour(ts) // 3 * 3 + 3) AS hour_range FROM events""")
def ts_generalise(spark, sf_dir):
    """Period, day type and hour range."""
    return table(spark, sf_dir, "events").select("event_id", times.generalise("ts").alias("g")).select("event_id", "g.*")


@query("""WITH b AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, min(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id) AS base, ts FROM events), s AS (SELECT *, ts - INTERVAL 100 DAY AS t FROM b)
SELECT user_id, event_id, (s - base) // 86400 AS day_index, '第' || ((s - base) // 86400 + 1) || '天' AS time_local, CASE WHEN hour(t) < 6 THEN 'night' WHEN hour(t) < 12 THEN 'morning' WHEN hour(t) < 18 THEN 'afternoon' ELSE 'evening' END AS period,
CASE WHEN isodow(t) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, printf('%02d-%02d', hour(t) // 3 * 3, hour(t) // 3 * 3 + 3) AS hour_range FROM s""")
def l2_relative_day(spark, sf_dir):
    """Times relative to the user's first event, nothing absolute left."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", times.epoch("ts").alias("ts")).withColumn("base", F.min("ts").over(W.partitionBy("user_id")))
    return privacy.level2(e, "base").drop("base").withColumn("day_index", F.col("day_index").cast("long"))


@query("""WITH f AS (SELECT source, min(doc_id) AS m FROM documents WHERE source <> '' GROUP BY source) SELECT source, '[PERSON_' || row_number() OVER (ORDER BY m, source) || ']' AS pseudonym FROM f""")
def pseudonym_dict(spark, sf_dir):
    """Pseudonyms in order of first occurrence."""
    return privacy.pseudonyms(table(spark, sf_dir, "documents"), "source", "doc_id")


@query(f"""WITH m AS (SELECT conv_id, unnest(list_filter([{', '.join(f"CASE WHEN {_any('text', w)} THEN '{k}' END" for k, w in LABELS.items())}], lambda x: x IS NOT NULL)) AS label FROM conversations),
g AS (SELECT label, count(*) AS hits FROM m GROUP BY label) SELECT label, hits, hits / (SELECT sum(hits) FROM g) AS share FROM g WHERE hits / (SELECT sum(hits) FROM g) > 0.1 ORDER BY share DESC, list_position({list(LABELS)}, label) LIMIT 3""")
def root_cause_share(spark, sf_dir):
    """the largest shares of label hits."""
    return reports.label_shares(table(spark, sf_dir, "conversations"), "text", LABELS)


@query(f"""WITH h AS (SELECT conv_id, turn, {_present('text', GOOD)} - {_present('text', BAD)} AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
g AS (SELECT conv_id, any_value(n) AS n, sum(CASE WHEN p > n // 2 THEN v ELSE -v END)::BIGINT AS change FROM h GROUP BY conv_id)
SELECT conv_id, n, change, CASE WHEN n < 3 THEN 'stable' WHEN change > 3 THEN 'improving' WHEN change < -3 THEN 'declining' ELSE 'stable' END AS trend FROM g""")
def trend_halves(spark, sf_dir):
    """second half against the first."""
    return reports.trend(table(spark, sf_dir, "conversations"), ["conv_id"], "text", ["turn"], GOOD, BAD)


@query(f"""WITH m AS (SELECT conv_id * 100 + turn AS seq, unnest(list_filter([{', '.join(f"CASE WHEN {_any('text', w)} THEN '{k}' END" for k, w in LABELS.items())}], lambda x: x IS NOT NULL)) AS label FROM conversations)
SELECT label, count(*) AS n, min(seq) AS first FROM m GROUP BY label HAVING count(*) >= 2 ORDER BY n DESC, first LIMIT 5""")
def profile_topk(spark, sf_dir):
    """frequent labels, ties by first occurrence."""
    c = table(spark, sf_dir, "conversations").withColumn("seq", F.col("conv_id") * 100 + F.col("turn"))
    return reports.top_labels(c, "text", LABELS, "seq", 5, 2)


@query("""SELECT role, avg(length(text)) AS avg_chars, CASE WHEN avg(length(text)) > 50 THEN 'verbose' WHEN avg(length(text)) < 10 THEN 'brief' ELSE 'balanced' END AS style FROM conversations GROUP BY role""")
def communication_style(spark, sf_dir):
    """style by role."""
    return reports.styles(table(spark, sf_dir, "conversations"), ["role"], "text").select("role", "avg_chars", "style")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, coalesce(list(text ORDER BY turn) FILTER (r <= 2), []) AS recent, coalesce(list(left(text, 40) ORDER BY turn) FILTER (r > 2 AND r <= 5), []) AS summary FROM r GROUP BY conv_id""")
def history_compress(spark, sf_dir):
    """The last turns whole, older ones cut."""
    return timeline.recent_and_summary(table(spark, sf_dir, "conversations"), 2, 3, order="turn")


@query(r"""WITH s AS (SELECT conv_id, unnest(string_split_regex(text, '[.!?。！？\n]+')) AS s FROM conversations)
SELECT conv_id, count(*) FILTER (contains(s, 'nicht') AND regexp_matches(s, '(^| )der( |$)')) AS about_first, count(*) FILTER (contains(s, 'nicht') AND regexp_matches(s, '(^| )die( |$)')) AS about_second,
CASE WHEN count(*) FILTER (contains(s, 'nicht') AND regexp_matches(s, '(^| )der( |$)')) + count(*) FILTER (contains(s, 'nicht') AND regexp_matches(s, '(^| )die( |$)')) = 0 THEN 1.0
ELSE 1 - 2 * abs(count(*) FILTER (contains(s, 'nicht') AND regexp_matches(s, '(^| )der( |$)')) / (count(*) FILTER (contains(s, 'nicht') AND regexp_matches(s, '(^| )der( |$)')) + count(*) FILTER (contains(s, 'nicht') AND regexp_matches(s, '(^| )die( |$)'))) - 0.5) END AS neutrality
FROM s WHERE trim(s) <> '' GROUP BY conv_id""")
def neutrality(spark, sf_dir):
    """Balance of criticism."""
    return reports.neutrality(table(spark, sf_dir, "conversations"), "conv_id", "text", "nicht", "(^| )der( |$)", "(^| )die( |$)")


@query("""WITH l AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), g AS (SELECT conv_id, arg_min(w, turn) AS f, arg_max(w, turn) AS l FROM l GROUP BY conv_id)
SELECT conv_id, list_sort(list_distinct(list_filter(l, lambda x: NOT list_contains(f, x)))) AS emerged, list_sort(list_distinct(list_filter(f, lambda x: NOT list_contains(l, x)))) AS faded FROM g""")
def set_evolution(spark, sf_dir):
    """What the last turn has and the first lacks, and the reverse."""
    c = table(spark, sf_dir, "conversations").withColumn("labels", F.split("text", " "))
    return reports.evolution(c, ["conv_id"], "labels", ["turn"])


@query("""SELECT conv_id, 'chunk_' || conv_id AS chunk, string_agg('[' || turn || ' 00:00] ' || role || ': ' || text, chr(10) ORDER BY turn) AS conversation_text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def transcript(spark, sf_dir):
    """Lines of each conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("day"), F.lit("00:00").alias("time"), F.col("role").alias("speaker"), F.lit("text").alias("modality"), "text")
    return chunks.transcript(rows, ["conv_id"], chunks.display_line("day", "time"), ["turn"]).withColumn("chunk", F.concat(F.lit("chunk_"), "conv_id"))


@query("""SELECT conv_id, turn, role || ': ' || text AS l2 FROM conversations""")
def speaker_prefix(spark, sf_dir):
    """Names before a colon become roles; here the role names are their own."""
    c = table(spark, sf_dir, "conversations").withColumn("line", F.concat("role", F.lit(": "), "text"))
    out = privacy.speaker_prefix("line", ["user"])
    back = F.when(out.startswith("ME:"), F.concat(F.lit("user"), F.substring(out, F.lit(3), F.length(out)))).otherwise(F.concat("role", F.substring(out, F.lit(6), F.length(out))))
    return c.select("conv_id", "turn", back.alias("l2"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) PIVOT g ON event_type IN ('click', 'login', 'purchase', 'view') USING coalesce(sum(n), 0)::BIGINT GROUP BY user_id""")
def comparison_pivot(spark, sf_dir):
    """counts by user with a column per type."""
    return reports.pivot_counts(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "login", "purchase", "view"])


@query("""SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def percentiles(spark, sf_dir):
    """Exact percentiles."""
    return reports.percentiles(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])


@query("""SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'purchase') / count(*) AS purchase_share, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, sum(value) AS total,
date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS days FROM events GROUP BY user_id""")
def kpi_dashboard(spark, sf_dir):
    """indicators by user in one pass."""
    return reports.kpis(table(spark, sf_dir, "events"), ["user_id"], {"events": F.count("*"), "kinds": F.count_distinct("event_type"), "purchase_share": F.count_if(F.col("event_type") == "purchase") / F.count("*"), "p50": F.percentile("value", 0.5), "p95": F.percentile("value", 0.95), "total": F.sum("value"), "days": F.datediff(F.max("ts"), F.min("ts"))})


@query("""SELECT event_type, d AS dimension, count(v) AS n, avg(v) AS mean, CASE WHEN count(v) = 1 THEN 0 ELSE stddev_samp(v) END AS sd FROM (SELECT event_type, 'value' AS d, value AS v FROM events UNION ALL SELECT event_type, 'user_id', user_id::DOUBLE FROM events) GROUP BY ALL""")
def dim_stats(spark, sf_dir):
    """mean and deviation by dimension."""
    return reports.dimension_stats(table(spark, sf_dir, "events"), ["value", "user_id"], ["event_type"])


@query("""WITH s AS (SELECT user_id, value AS a, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, avg(abs(a / 10 - b / 10)) AS difference, count(*) AS n, CASE WHEN avg(abs(a / 10 - b / 10)) <= 1 THEN 'high' WHEN avg(abs(a / 10 - b / 10)) <= 2 THEN 'medium' ELSE 'low' END AS consistency FROM s GROUP BY user_id""")
def annotator_consistency(spark, sf_dir):
    """F16: agreement of paired scores."""
    e = table(spark, sf_dir, "events").withColumn("b", F.lead("value").over(W.partitionBy("user_id").orderBy("event_id"))).select("user_id", (F.col("value") / 10).alias("a"), (F.col("b") / 10).alias("b"))
    return reports.annotator_consistency(e, ["user_id"], [("a", "b")])


@query("""WITH d AS (SELECT ts::DATE AS day, sum(value) AS spent FROM events GROUP BY ALL) SELECT day, spent, sum(spent) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS month_spent, 1000000 - sum(spent) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS left FROM d""")
def cost_report(spark, sf_dir):
    """daily costs and what is left of the budget."""
    return reports.costs(table(spark, sf_dir, "events"), "ts", "value", 1000000.0)


@query("""WITH b AS (SELECT event_id, user_id % 7 AS a, user_id % 5 + 7 AS b, CASE WHEN value > 60 THEN 'a_win' WHEN value < 40 THEN 'b_win' ELSE 'tie' END AS vote, event_type FROM events),
l AS (SELECT event_type, 'm' || a AS model, (vote = 'a_win')::INT AS win FROM b UNION ALL SELECT event_type, 'm' || b, (vote = 'b_win')::INT FROM b)
SELECT event_type, model, count(*) AS battles, sum(win)::BIGINT AS wins, sum(win) / count(*) AS win_rate FROM l GROUP BY ALL""")
def bt_winloss(spark, sf_dir):
    """Wins by model and category."""
    e = table(spark, sf_dir, "events")
    b = e.select("event_type", F.concat(F.lit("m"), F.col("user_id") % 7).alias("model_a"), F.concat(F.lit("m"), F.col("user_id") % 5 + 7).alias("model_b"), F.when(F.col("value") > 60, "a_win").when(F.col("value") < 40, "b_win").otherwise("tie").alias("vote"))
    return reports.wins(b, ["event_type"])


@query()
def bt_ratings(spark, sf_dir):
    """Bradley-Terry ratings; iterative, checked in the tests."""
    from parley.operators.ranking import bradley_terry

    e = table(spark, sf_dir, "events")
    b = e.select(F.concat(F.lit("m"), F.col("user_id") % 7).alias("model_a"), F.concat(F.lit("m"), F.col("user_id") % 5 + 7).alias("model_b"), F.when(F.col("value") > 60, 1.0).when(F.col("value") < 40, 0.0).otherwise(0.5).alias("wins_a"))
    return bradley_terry(b.withColumn("wins_b", 1 - F.col("wins_a")))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, floor(value)::INT ORDER BY event_id) AS r FROM events) SELECT event_id, r >= 2 AS is_ref, CASE WHEN r >= 2 THEN '[REF:' || left(sha256(event_type || floor(value)::INT), 8) || ']' ELSE event_type END AS encoded FROM r""")
def dictionary_encode(spark, sf_dir):
    """Later occurrences become references."""
    from parley.operators.media import dictionary_encode as encode

    e = table(spark, sf_dir, "events").withColumn("sha", F.sha2(F.concat("event_type", F.floor("value").cast("int").cast("string")), 256))
    return encode(e, "sha", "event_id", "event_type").select("event_id", "is_ref", "encoded")


@query("""WITH k AS (SELECT event_id, user_id, ts, event_type FROM events), m AS (SELECT user_id, max(event_id) AS e FROM k GROUP BY user_id) SELECT k.user_id, k.event_id, k.event_type FROM k JOIN m ON k.event_id = m.e""")
def keyed_last_wins(spark, sf_dir):
    """The last row of each key."""
    return joins.last_by_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
