"""Links, quotes, fusion and restoring on small inputs."""

from pyspark.sql import functions as F

from parley.operators import fusion, links


def test_extract(spark):
    rows = [("a:1", 5, "", "https://www.youtube.com/x", "t", None, None), ("a:2", 6, "", None, "", "raw/docs/f.PDF", None), ("a:3", 33, "<appid>wx1</appid>", None, None, None, ""), ("a:4", 99, "?", None, None, "raw/image/i.jpg", None), ("a:5", 57, "reply", None, None, None, None)]
    df = spark.createDataFrame(rows, "msg_uid string, sub_type int, text_raw string, link_url string, link_title string, media_path string, appid string")
    sizes = spark.createDataFrame([("docs/f.PDF", 9)], "path string, length long")
    out = {r.msg_uid: r for r in links.extract(df, sizes).collect()}
    assert out["a:1"].link_type == "video" and out["a:2"].file_name == "f.PDF" and out["a:2"].file_category == "document" and out["a:2"].file_size == 9
    assert out["a:3"].miniprogram_appid == "wx1" and out["a:4"].link_sub_type == "unknown" and out["a:4"].media_path == "raw/image/i.jpg" and out["a:5"].quote_reply == "reply"
    assert "link_url" not in links.timeline_fields(links.extract(df), slim=True).columns


def test_header(spark):
    r = links.header(spark.createDataFrame([(None, "x", 1)], "ts long, msg_uid string, extra int"), {"speaker": F.lit(None).cast("string")}).first()
    assert r.ts == 0 and r.msg_uid == "x" and r.speaker is None and r.schema_version == "merged_v2" and r.extra == 1


def test_quotes(spark):
    df = spark.createDataFrame([("P1:7", "own", 1), ("P1:8", "kept", 2)], "msg_uid string, quote_text string, quote_type int")
    lookup = spark.createDataFrame([("7", "old", 3, 1), ("7", "new", 4, 2)], "svr_id string, quote_text string, quote_type int, seq int")
    assert sorted((r.msg_uid, r.quote_text, r.quote_type) for r in links.quotes(df, lookup).collect()) == [("P1:7", "new", 4), ("P1:8", "kept", 2)]


def test_derived_key(spark):
    df = spark.createDataFrame([("voice/a.mp3",), ("./voice/b.mp3",), (None,)], "media_path string")
    side = spark.createDataFrame([("a.mp3", "hello")], "file string, text string")
    out = {r.media_path: (r.text, r.matched) for r in links.by_file_name(df, side, "media_path", "(?:\\.?/)?voice/([^/]+\\.mp3)", "file").collect()}
    assert out == {"voice/a.mp3": ("hello", True), "./voice/b.mp3": (None, False), None: (None, False)}


def test_codes_and_markers(spark):
    df = spark.createDataFrame([("image", 0), ("link_or_file", 6), ("link_or_file", 1)], "m string, s int")
    assert [r.c for r in df.select(links.message_code("m", "s").alias("c")).collect()] == ["image", "file", "link"]
    t = spark.createDataFrame([("SKIP", "small"), ("FULL", "")], "t string, r string").select(links.skip_marker("t", "r").alias("x")).collect()
    assert t[0].x.description == "skipped: small" and t[1].x is None


def test_merge_analyses(spark):
    kind = "struct<issues: array<string>, note: string, risk: string>"
    df = spark.createDataFrame([(1, (["a", " b"], "x", "low"), (["b", "c"], "y", "High")), (2, (["a"], "x", None), None)], f"id int, p {kind}, q {kind}")
    out = {r.id: r for r in fusion.merge_analyses(df, {"first": "p", "second": "q"}, ["issues"], ["note"], "risk").collect()}
    assert (out[1].issues, out[1].note, out[1].risk, out[1].merged_from) == (["a", "b", "c"], "x / y", "high", "first+second")
    assert (out[2].issues, out[2].risk, out[2].merged_from) == (["a"], "none", "first")


def test_fuse_and_restore(spark):
    df = spark.createDataFrame([("A cat sits. It is red.", "A cat sits! Rain falls.")], "a string, b string")
    assert df.select(fusion.fuse_captions("a", "b").alias("x")).first().x == "A cat sits. It is red. Rain falls."
    t = spark.createDataFrame([("ME saw [PERSON_1] and [PERSON_11], SOME time",)], "t string")
    assert t.select(fusion.restore(F.col("t"), {"[PERSON_1]": "Ann", "[PERSON_11]": "Bob"}, {"ME": "Joe"}).alias("x")).first().x == "Joe saw Ann and Bob, SOME time"


def test_json_fields(spark):
    df = spark.createDataFrame([('{"a": {"score": 3}, "l": ["x", "y"]}',), ('{"l": "z"}',), (None,)], "j string")
    out = df.select(fusion.six_dimensions("j", ["a", "b"]).alias("d"), fusion.one_or_many("j", "$.l").alias("l")).collect()
    assert out[0].d.a == 3.0 and out[1].d is None and [r.l for r in out] == [["x", "y"], ["z"], []]
    n = spark.createDataFrame([(["bad thing", "ok"],)], "i array<string>").select(fusion.numbered("i", {"bad": "hard"}).alias("x")).first().x
    assert n == "  1. hard thing\n  2. ok"
