"""Operators on small inputs: the rules, their edges, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import times
from parley.operators import chunks, graph, joins, media, messages, privacy, ranking, reports, timeline


def one(df):
    return df.collect()[0]


def message_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, ts long, speaker string, modality string, text_raw string, emotion_tags array<string>, msg_uid string")


def test_validation_codes(spark):
    df = spark.createDataFrame([("a", 5, "ME", 1, "text", "x"), ("b", 0, "THEM", 1, "smell", None), (None, 3, "OTHER:Ann", 1, "image", "y")], "msg_uid string, ts long, speaker string, type int, modality string, text_raw string")
    assert [sorted(r.errors) for r in messages.validate(df).collect()] == [[], ["missing:text_raw", "modality", "speaker", "ts"], ["missing:msg_uid"]]
    assert {r.error: r.n for r in messages.error_report(df).collect()}["ts"] == 1


def test_canonical_has_all_columns(spark):
    df = messages.canonical(spark.createDataFrame([("a", 1)], "msg_uid string, extra int"))
    assert df.columns == messages.CANONICAL.names and one(df).seq_in_html == -1 and one(df).sub_type == 0


def test_mapping(spark):
    df = spark.createDataFrame([("1", "", "z"), (None, "b", "")], "x string, y string, z string")
    out = messages.apply_mapping(df, {"x": "t", "y": "t", "_default:d": "t", "_const:c": "k", "z": "u"}).collect()
    assert [(r.t, r.k, r.u) for r in out] == [("1", "c", "z"), ("b", "c", None)]
    assert messages.mapping_errors({"a": "ts"}) == ["modality", "speaker", "text_raw", "type"]


def test_trim_keeps_the_columns_of_the_modality(spark):
    df = spark.createDataFrame([("1", "ME", "t", "text", "hi", None, None), ("2", "ME", "t", "image", "raw", "s", "o" * 300), ("3", "ME", "t", "image", "raw", "", "o" * 300)], "msg_uid string, speaker string, time_local string, modality string, text_raw string, summary string, ocr_text string")
    out = {r.msg_uid: r for r in messages.trim_for_training(df).collect()}
    assert out["1"].text_raw == "hi" and out["2"].text_raw is None and out["2"].ocr_text is None and out["3"].ocr_text == "o" * 300


def test_merge_and_gap(spark):
    df = message_rows(spark, [(1, 1, 1000, "ME", "text", "a", [], "u1"), (1, 2, 1060, "ME", "text", "b", [], "u2"), (1, 3, 1121, "ME", "text", "c", [], "u3"), (1, 4, 1122, "ME", "image", "d", [], "u4"), (1, 5, 90000, "OTHER", "text", "e", [], "u5")])
    merged = timeline.merge_messages(df).orderBy("seq").collect()
    assert [(m.text_raw, m.merged_count) for m in merged] == [("a b", 2), ("c", 1), ("d", 1), ("e", 1)]
    gap = timeline.gap_rows(df).collect()
    assert len(gap) == 1 and gap[0].break_type == "day_change" and gap[0].msg_uid == "TIME_GAP_1122_90000"


def test_clashing_tags_stay_apart(spark):
    df = message_rows(spark, [(1, 1, 1, "ME", "text", "a", ["HAPPY"], "1"), (1, 2, 2, "ME", "text", "b", ["ANGRY"], "2"), (1, 3, 3, "ME", "text", "c", ["ANGRY"], "3")])
    assert sorted(m.text_raw for m in timeline.merge_messages(df).collect()) == ["a", "b c"]


def test_merge_conserves_messages(spark):
    rng = random.Random(3)
    rows = [(c, i, 100 * i + rng.randrange(120), rng.choice(["ME", "OTHER"]), "text", f"t{i}", [], f"{c}-{i}") for c in range(5) for i in range(40)]
    merged = timeline.merge_messages(message_rows(spark, rows)).collect()
    assert sorted(u for m in merged for u in m.original_ids) == sorted(r[7] for r in rows)


@pytest.mark.parametrize("seconds, text", [(-5, "0分钟"), (0, "0分钟"), (59, "0分钟"), (3599, "59分钟"), (3600, "1小时"), (3660, "1小时1分钟"), (86400, "1天"), (90000, "1天1小时")])
def test_gap_text(spark, seconds, text):
    assert one(spark.range(1).select(times.describe_gap(F.lit(seconds)).alias("g"))).g == text


def plain_rapid(rows, within=60, rapid=10, most=20):
    """The merge rule as a plain loop over the open group."""
    out, group = [], []
    for r in rows:
        ok = bool(group) and group[-1]["speaker"] == r["speaker"] and r["ts"] - group[-1]["ts"] <= within
        if ok:
            trial = [*group, r]
            ok = not (all(len(x["text"]) <= most for x in trial) and all(b["ts"] - a["ts"] <= rapid for a, b in zip(trial, trial[1:])))
        if ok:
            group.append(r)
        else:
            group = [r]
            out.append(group)
    return [len(g) for g in out]


def test_rapid_fire_equals_plain_loop(spark):
    rng = random.Random(1)
    ts, rows = 0, []
    for i in range(200):
        ts += rng.choice([1, 5, 9, 11, 40, 90])
        rows.append({"ts": ts, "speaker": rng.choice(["ME", "ME", "OTHER"]), "text": "x" * rng.choice([1, 5, 30])})
    df = message_rows(spark, [(1, i, r["ts"], r["speaker"], "text", r["text"], [], str(i)) for i, r in enumerate(rows)])
    assert [r.merged_count for r in timeline.merge_rapid_fire(df).orderBy("seq").collect()] == plain_rapid(rows)


def plain_segments(rows, least, most, gap, shift):
    segments, now = [], []
    for r in rows:
        if now and (len(now) >= most or (len(now) >= least and (r[0] - now[-1][0] >= gap or abs(r[1] - now[-1][1]) >= shift))):
            segments.append(now)
            now = []
        now.append(r)
    if len(now) >= least:
        segments.append(now)
    elif now and segments and len(segments[-1]) + len(now) <= most:
        segments[-1] += now
    return [len(s) for s in segments]


def test_event_segments_equal_plain_loop(spark):
    rng = random.Random(2)
    rows, ts = [], 0
    for _ in range(150):
        ts += rng.choice([10, 30000])
        rows.append((ts, rng.choice([-1.0, 0.0, 0.2, 1.0])))
    df = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(rows)], "conv_id long, seq long, ts long, sentiment double")
    got = timeline.segment_by_events(df, 4, 9, 21600, 0.5).where("segment is not null").groupBy("segment").count().orderBy("segment").collect()
    assert [r["count"] for r in got] == plain_segments(rows, 4, 9, 21600, 0.5)


def test_hopping_bounds(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(37)], "conv_id long, seq long, ts long")
    got = {r.start: r.n for r in timeline.hopping(df).groupBy("start").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 20, 10: 20, 20: 17}
    assert timeline.hopping(df.where("seq < 9")).count() == 0


def test_dense_ids_and_times(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "uid string, seq long")
    assert {r.uid: r.id for r in timeline.dense_ids(df, "uid", "seq").collect()} == {"b": 1, "a": 2}


def test_arguments_do_not_overlap(spark):
    rows = [(1, i, i * 10, "ME" if i % 2 else "OTHER", "text", "no way", [], str(i)) for i in range(20)]
    starts = sorted(r.i for r in timeline.arguments(message_rows(spark, rows), ["no"]).collect())
    assert starts == [1, 7, 13]


def test_cold_rows(spark):
    rows = [(1, i, i * 30000, "ME", "text", "ok", [], str(i)) for i in range(6)]
    assert sorted(r.seq for r in timeline.cold_rows(message_rows(spark, rows), ["ok"]).collect()) == [1, 2]


def test_frame_changes(spark):
    assert one(spark.createDataFrame([(["abc", "abd", "xyz", "xyw"],)], "f array<string>").select(timeline.frame_changes("f").alias("x"))).x == ["abc", "xyz"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Hello,  world!! Hello",), ("",), (None,), ("a\x00b�c",), ("好累啊 好累",)], "t string")
    out = df.select(X.collapse_punctuation("t").alias("p"), X.distinct_words("t").alias("d"), X.clean_unicode("t").alias("c"), X.estimate_tokens("t").alias("e"), X.present_words("t", ["累", "Hello", "x"]).alias("n"), X.tokens("t").alias("k")).collect()
    assert out[0].p == "Hello,  world! Hello" and out[0].d == "Hello, world!! Hello" and out[1].c is None and out[2].d == "" and out[3].c == "abc"
    assert out[4].e == 3 and out[4].n == 1 and out[2].n == 0 and "好累" in out[4].k


def test_repetitive(spark):
    df = spark.createDataFrame([("ha ha ha ha ho",), ("one two three four",), ("ha",)], "t string")
    assert [r.x for r in df.select(X.is_repetitive("t").alias("x")).collect()] == [True, False, False]


def test_json_block(spark):
    df = spark.createDataFrame([("<think>{no}</think> text ```json\n{\"a\": 1}\n``` tail",), ("x {\"b\": {\"c\": 2}} y",), ("none",)], "t string")
    assert [r.j for r in df.select(X.json_block("t").alias("j")).collect()] == ['{"a": 1}', '{"b": {"c": 2}}', None]


def test_privacy(spark):
    df = spark.createDataFrame([("call 13812345678 or a.b@c.org, id wxid_ab12",), ("Anna: hi",), ("张三: 好",)], "t string")
    counts = [r.c for r in df.select(privacy.pii_counts("t").alias("c")).collect()]
    assert counts[0].PHONE == 1 and counts[0].EMAIL == 1 and counts[0].WECHAT_ID == 1
    red = [r.x for r in df.select(privacy.redact("t").alias("x")).collect()]
    assert red[0] == "call [PHONE] or [EMAIL], id [WECHAT_ID]"
    assert [r.x for r in df.select(privacy.speaker_prefix("t", ["anna"]).alias("x")).collect()][1:] == ["ME: hi", "OTHER: 好"]


def test_names_longest_first(spark):
    df = spark.createDataFrame([("Ann and Anna met Ann.",)], "t string")
    assert one(df.select(privacy.replace_names("t", {"Ann": "[1]", "Anna": "[2]"}).alias("x"))).x == "[1] and [2] met [1]."


def test_level2_has_no_absolute_time(spark):
    df = spark.createDataFrame([(1, 1700000000), (1, 1700000000 + 3 * 86400 + 5), (1, 1700000000 - 1)], "c long, ts long").withColumn("base", F.lit(1700000000))
    out = privacy.level2(df, "base")
    assert "ts" not in out.columns and sorted(r.day_index for r in out.collect()) == [-1, 0, 3]


def test_crisis_levels(spark):
    df = spark.createDataFrame([("我真的不想活",), ("笑死我了 死",), ("ok",)], "t string")
    level = privacy.crisis("t", {"RED": [], "ORANGE": ["死"], "YELLOW": []}, {"ORANGE": ["不想活"], "RED": ["跳下去"]}, ["我"], ["笑死"])
    assert [r.l for r in df.select(level.alias("l")).collect()] == ["ORANGE", "YELLOW", "GREEN"]


def test_joins(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    u = spark.createDataFrame([(2, "z"), (3, "y")], "k long, v string")
    assert sorted((r.k, r.v, r.updated) for r in joins.upsert(t, u, "k").collect()) == [(1, "a", False), (2, "z", True)]
    last = joins.last_by_key(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3)], "k long, v string, s long"), "k", "s")
    assert [(r.k, r.v) for r in last.collect()] == [(1, "b")]
    spans = spark.createDataFrame([([(0, 5, 0.5), (3, 12, 0.5), (20, 22, 0.1), (20, 22, 0.9)],)], "s array<struct<start: int, end: int, confidence: double>>")
    assert [(x.start, x.end, x.confidence) for x in one(spans.select(joins.resolve_spans("s").alias("r"))).r] == [(3, 12, 0.5), (20, 22, 0.9)]


def test_band_equals_brute_force(spark):
    rng = random.Random(5)
    a, b = [(rng.randrange(3), rng.randrange(60)) for _ in range(80)], [(rng.randrange(3), rng.randrange(60)) for _ in range(80)]
    l, r = spark.createDataFrame(a, "g long, x long"), spark.createDataFrame(b, "g long, y long")  # noqa: E741
    got = sorted((q.g, q.x, q.y) for q in joins.band(l, r, ["g"], "x", "y", 3).collect())
    assert got == sorted((g, x, y) for g, x in a for h, y in b if g == h and abs(x - y) <= 3)


def test_associations(spark):
    df = spark.createDataFrame([("a", 5, [9], "x", "same cause"), ("b", 9, [], "y", ""), ("c", 6, [], "z", "same cause"), ("d", 7, [], "x", "")], "chunk_id string, day long, refers array<long>, type string, cause string")
    got = {(r.chunk_id, r.other_id): r.rule for r in joins.associations(df, 3).collect()}
    assert got[("a", "b")] == 1 and got[("a", "c")] == 2 and ("a", "d") not in got


def test_rank_fusion_ignores_scale(spark):
    df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate([5, 3, 9, 1])], "q long, id long, s double")
    scaled = df.withColumn("s", F.col("s") * 100)
    fuse = lambda d: {r.id: round(r.score, 9) for r in ranking.fuse([ranking.rank_in(d, ["q"], "s", "id")], ["q"], "id").collect()}
    assert fuse(df) == fuse(scaled) and fuse(df)[2] == round(1 / 61, 9)


def test_bradley_terry_order(spark):
    df = spark.createDataFrame([("a", "b", 9.0, 1.0), ("b", "c", 8.0, 2.0), ("a", "c", 9.0, 1.0)], "model_a string, model_b string, wins_a double, wins_b double")
    r = {x.model: x.rating for x in ranking.bradley_terry(df).collect()}
    assert r["a"] > r["b"] > r["c"]


def test_rouge(spark):
    df = spark.createDataFrame([("abcde", "ace"), ("abc", "abc"), ("", "x"), (None, "x")], "a string, b string")
    assert [round(r.r, 6) for r in df.select(ranking.rouge_column("a", "b").alias("r")).collect()] == [0.75, 1.0, 0.0, 0.0]


def test_graph(spark):
    nodes = spark.createDataFrame([(1, [2, 2, 9]), (2, [3]), (3, [3]), (4, [5]), (5, []), (6, [])], "id long, related array<long>")
    edges = graph.build(nodes, "id", "related")
    assert sorted((e.src, e.dst) for e in edges.collect()) == [(1, 2), (2, 3), (4, 5)]
    assert {r.id: r.distance for r in graph.distances(edges, spark.createDataFrame([(1,)], "id long"), 5).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r.id: r.component for r in graph.components(nodes, "id", edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_split_keeps_small_groups_whole(spark):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(22)], "id long, s string")
    n = {(r.s, r.split): r["count"] for r in chunks.stratified_split(df, "id", "s").groupBy("s", "split").count().collect()}
    assert n == {("a", "train"): 16, ("a", "validation"): 2, ("a", "test"): 2, ("b", "train"): 2}


def test_verdict(spark):
    df = spark.createDataFrame([(44, "fail"), (36, None), (20, None), (5, None), (30, "pass")], "t int, v string")
    assert [r.x for r in df.select(chunks.verdict("t", "v").alias("x")).collect()] == ["pass", "pass", "needs_revision", "fail", "pass"]


def test_media(spark):
    df = spark.createDataFrame([(100, 100, 10), (50, 60, 9000), (9000, 500, 9000), (200, 100, 9000), (800, 600, 9000)], "w int, h int, s int")
    assert [r.t for r in df.select(media.image_tier("w", "h", "s")["tier"].alias("t")).collect()] == ["SKIP", "SKIP", "SLICE", "LITE", "FULL"]
    assert one(spark.range(1).select(media.even_stride(F.lit(10), 4).alias("x"))).x == [0, 2, 5, 7]
    assert one(spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n" + b"0" * 9),)], "b binary").select(media.magic("b").alias("x"))).x == "png"


def test_counts_by_grouping_sets(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None)], "p string, q string")
    assert {(r.dimension, r.value): r.n for r in reports.counts(df, ["p", "q"]).collect()} == {("p", "a"): 2, ("q", "x"): 1, ("q", "(none)"): 1, ("total", ""): 2}
