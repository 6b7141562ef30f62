"""Review rules, mapped JSON lines, line numbers of split files, paths of many groups, failing batches."""

import datetime

from pyspark.sql import functions as F

from parley.operators import graph, inference, retrieval, review
from parley.sources import files


def test_pages_come_back_edited_or_not(spark):
    rows = [(1, "a\n\n> b", "fine\nreally", ["x", "y z"], True), (2, None, None, None, None), (3, "é", "", [], False)]
    df = spark.createDataFrame(rows, "id long, c string, a string, s array<string>, r boolean").withColumn("page", review.to_markdown("id", "c", "a", "s", "r"))
    got = {r.x.id: tuple(r.x)[1:] for r in df.select(review.from_markdown("page").alias("x")).collect()}
    assert got == {"1": ("a\n\n> b", "fine\nreally", ["x", "y z"], True), "2": ("", "", [], False), "3": ("é", "", [], False)}
    edited = df.where("id = 3").select(review.from_markdown(F.regexp_replace(F.regexp_replace("page", "- \\[ \\]", "- [X]"), "## Suggestions\n", "## Suggestions\r\n\r\n* more  \r\n- less\r\n")).alias("x")).first().x
    assert edited.reviewed and edited.suggestions == ["more", "less"] and edited.conversation == "é"
    assert df.select(review.from_markdown(F.lit("no page")).alias("x")).first().x == ("", "", "", [], False)


def test_items_by_state(spark):
    rows = [(1, None, True, None), (2, "x" * 300, False, None), (3, "c", None, "approve"), (4, "d", False, "reject"), (5, "e", True, "reject")]
    df = spark.createDataFrame(rows, "id long, conversation string, passed boolean, human_decision string")
    ids = lambda which: sorted(r.id for r in review.review_items(df, which).collect())
    assert (ids("all"), ids("pending"), ids("passed"), ids("failed")) == ([1, 2, 3, 4, 5], [1, 2], [1, 3, 5], [2, 4])
    assert tuple(review.review_counts(df).first()) == (5, 2, 3, 1, 2, 2) and tuple(review.review_counts(df.limit(0)).first()) == (0,) * 6
    assert {r.id: len(r.preview) for r in review.review_items(df).collect()} == {1: 0, 2: 200, 3: 1, 4: 1, 5: 1}


def test_small_rules(spark):
    point = lambda x, y: {"x": float(x), "y": float(y)}
    tall, wide = [point(0, 0), point(1, 0), point(1, 2)], [point(0, 0), point(3, 0), point(3, 1)]
    df = spark.createDataFrame([(1, [tall] * 2), (2, [tall] * 2 + [wide]), (3, [tall, wide, wide]), (4, None), (5, [])], "id int, b array<array<struct<x:double,y:double>>>")
    assert {r.id for r in df.where(review.turned("b")).collect()} == {2}
    s = spark.createDataFrame([(1, "sticker", 47, "raw/http://a", None), (2, "sticker", 47, "", "http://b"), (3, "sticker", 47, "x", None), (4, "text", 47, "http://c", None), (5, "sticker", 3, "http://c", None)], "id int, modality string, type int, text_raw string, media_path string")
    assert sorted((r.id, r.url) for r in review.stickers(s).collect()) == [(1, "http://a"), (2, "http://b")]
    at = spark.createDataFrame([(1, None), (2, ""), (3, "2024-01-01T00:00:00"), (4, "2024-01-09T12:00:00")], "id int, at string")
    now = F.lit(datetime.datetime(2024, 1, 10, 12))
    assert {r.id for r in review.within_days(at, "at", now, 1).collect()} == {1, 2, 4} and review.within_days(at, "at", now, 0).count() == 4
    assert spark.range(1).select(review.bias_hits(F.lit("x bias=anchor-1 bias: halo abias=no")).alias("b")).first().b == ["anchor-1", "halo"]
    chunks = review.chunk_rows(spark.createDataFrame([("c", None, "t", 3)], "conversation_id string, conversation string, conversation_text string, n int"))
    assert tuple(chunks.first()) == ("c", "t", "", {"n": "3"})


def test_line_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i}" + ("\r\n" if i % 5 else "\n") + ("\n" if i % 7 == 0 else "") for i in range(n)), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        every = files.lines(spark, str(tmp_path)).collect()
        told = files.lines(spark, str(tmp_path), blank=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.line_no, r.line) for r in told if "a.txt" in r.file} == {(i + 1, f"a.txt {i}") for i in range(3000)} and len(told) == 3001
    want, n = {}, 0
    for i in range(3000):
        n += 1
        want[n] = f"a.txt {i}"
        if i % 7 == 0:
            n += 1
            want[n] = ""
    assert {r.line_no: r.line for r in every if "a.txt" in r.file} == want


def test_mapped_lines_count_bad_ones(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"t": "5", "w": "ann", "k": {"a": 1}}\n\n{bad\n  \n"text"\n{"t": "x", "w": "OTHER:b"}\n{"w": "zed"}\n')
    out = files.mapped_jsonl(spark, str(tmp_path / "x.jsonl"), {"t": "ts", "w": "speaker", "k": "extra", "_const:text": "modality"}, "P", {"ann": "ME"}).collect()
    assert sorted((r.msg_uid, r.ts, r.speaker, r.extra, r.modality) for r in out) == [("P:1", 5, "ME", '{"a":1}', "text"), ("P:4", 0, "OTHER:b", None, "text"), ("P:5", 0, "OTHER:zed", None, "text")]


def test_paths_of_groups_do_not_mix(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (2, 9)], "src long, dst long")
    seeds = spark.createDataFrame([("a", 1, 1), ("b", 5, 1), ("b", 4, 2), ("c", 77, 1)], "group string, id long, rank int")
    got = {(r.group, r.id): r.distance for r in graph.group_distances(edges, seeds, 2).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("a", 9): 2, ("b", 5): 0, ("b", 6): 1, ("b", 4): 0, ("b", 3): 1, ("b", 2): 2, ("c", 77): 0}
    bridges = spark.createDataFrame([("a", 3), ("a", 6), ("b", 6), ("c", 77), ("d", 1)], "group string, id long")
    assert {r.distance: r.n for r in graph.bridge_lengths(edges, seeds, bridges, 2).collect()} == {2: 1, None: 2, 1: 1, 0: 1}
    arms = {"seeds": seeds, "one": graph.expand_groups(edges, seeds, 1, 5)}
    assert {r.arm: round(r.recall, 3) for r in graph.arm_recall(arms, bridges, 4).collect()} == {"seeds": 0.25, "one": 0.5}


def test_only_texts_that_fail_have_an_error(spark):
    def make():
        calls = [0]

        def model(texts):
            calls[0] += 1
            if any("bad" in t for t in texts) or calls[0] == 1:
                raise ValueError("no")
            return [t.upper() for t in texts]

        return model

    df = spark.createDataFrame([(i, "bad" if i in (3, 40) else f"t{i}") for i in range(60)], "id long, t string").coalesce(1)
    out = {r.id: (r.output, r.error) for r in inference.apply_model(df, "id", "t", make, batch=16, retries=1).collect()}
    assert out == {i: (None, "ValueError: no") if i in (3, 40) else (f"T{i}", None) for i in range(60)}


def test_days_by_mode(spark):
    chunks = spark.createDataFrame([("c1", [1, 9], 5, 0.5), ("c2", [10], 4, 0.9), ("c3", [12], 3, 0.1), ("c4", [50], 2, 1.0), ("c5", [11], 1, None)], "chunk_id string, days array<int>, ts long, s double")
    names = lambda mode, k: [r.chunk_id for r in retrieval.search_days(chunks, 9, 12, mode, F.col("s"), k).collect()]
    assert names("exact", 5) == ["c5", "c3", "c2", "c1"] and names("semantic", 2) == ["c2", "c1"] and names("hybrid", 1) == ["c2"] and names("hybrid", 3) == ["c2", "c1", "c3"]
