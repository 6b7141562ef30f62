"""Readers and writers: round trips and malformed input."""

import json


from parley.sources import files, sinks


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2, "b": "é"}\n', encoding="utf-8")
    out = files.jsonl(spark, str(tmp_path), "a long, b string", numbered=True).orderBy("line_no").collect()
    assert [(r.line_no, r.a, r.b) for r in out] == [(1, 1, None), (4, 2, "é")]
    assert files.count_lines(spark, str(tmp_path)) == 3


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x\ny"), (2, None)], "a long, b string")
    sinks.jsonl(df, str(tmp_path / "o"))
    assert sorted((r.a, r.b) for r in files.jsonl(spark, str(tmp_path / "o"), "a long, b string").collect()) == [(1, "x\ny"), (2, None)]


def test_mapped_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time,who,what\n5,Ann,"hi, ""you"""\nbad,Bob,\n', encoding="utf-8")
    out = files.mapped_csv(spark, str(tmp_path), {"time": "ts", "who": "speaker", "what": "text_raw", "_const:1": "type", "_const:text": "modality"}, "CSV", {"Ann": "ME"}).orderBy("msg_uid").collect()
    assert [(r.msg_uid, r.ts, r.speaker, r.text_raw) for r in out] == [("CSV:1", 5, "ME", 'hi, "you"'), ("CSV:2", 0, "Bob", None)]


def test_telegram(spark, tmp_path):
    doc = {"messages": [{"id": 1, "type": "message", "date": "2024-01-02T03:04:05", "from": "Ann", "text": ["a ", {"type": "bold", "text": "b"}]}, {"id": 2, "type": "service", "text": ""}, {"id": 3, "type": "message", "date": "?", "from": "Bob", "text": "t", "photo": "p.jpg"}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    out = files.telegram(spark, str(tmp_path / "r.json"), {"Ann": "ME"}).orderBy("msg_uid").collect()
    assert [(r.msg_uid, r.ts, r.speaker, r.modality, r.text_raw) for r in out] == [("TG:1", 1704164645, "ME", "text", "a b"), ("TG:3", 0, "OTHER:Bob", "image", "t")]


def test_chat_text(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1/2/24, 3:04 PM - Ann: hello\nmore\n1/2/24, 3:05 PM - Bob: IMG-1.jpg (file attached)\n13/2/2024, 15:04 - Bob: late\n", encoding="utf-8")
    out = files.chat_text(spark, str(tmp_path / "c.txt"), {"Ann": "ME"}).orderBy("seq").collect()
    assert [(r.msg_uid, r.ts, r.speaker, r.modality, r.text_raw) for r in out][0] == ("WA:1", 1704207840, "ME", "text", "hello\nmore")
    assert out[1].modality == "image" and out[1].media_path == "IMG-1.jpg" and out[2].ts == 1707836640


def test_html_export_round_trip(spark, tmp_path):
    html = 'x <script>var chatMessages = [{type: 1, sub_type: 0, is_send: 1, timestamp: 5, text: "a ] \\" b", MsgSvrID: "m1"},{"type":1,"is_send":0,"timestamp":6,"text":"c"},];</script>'
    (tmp_path / "e.html").write_text(html)
    (tmp_path / "e.csv").write_text("localId,CreateTime,Type,IsSender,Sender\n7,5,1,1,Ann\n8,6,1,0,Bob\n")
    out = files.html_export(spark, str(tmp_path / "e.html"), str(tmp_path / "e.csv"), ["Ann"]).orderBy("seq").collect()
    assert [(r.speaker, r.text_raw, r.local_id) for r in out] == [("ME", 'a ] " b', "7"), ("OTHER", "c", "8")]
    page = sinks.html_page(files.html_export(spark, str(tmp_path / "e.html"), str(tmp_path / "e.csv"), ["Ann"])).collect()[0].value
    (tmp_path / "f.html").write_text(page)
    again = files.html_export(spark, str(tmp_path / "f.html"), str(tmp_path / "e.csv"), ["Ann"]).orderBy("seq").collect()
    assert [(r.speaker, r.text_raw) for r in again] == [(r.speaker, r.text_raw) for r in out]


def test_targets_do_not_collide(spark):
    df = spark.createDataFrame([(1, "image/a.jpg", "s1"), (2, "image/a.jpg", "s2"), (3, "image/a.jpg", "s1")], "order long, target string, sha string")
    assert [r.final for r in sinks.distinct_targets(df, "target", "sha").orderBy("order").collect()] == ["image/a.jpg", "image/a_s2.jpg", "image/a.jpg"]


def test_markdown(spark):
    df = spark.createDataFrame([(5, 1, "OTHER:Ann", "b"), (4, 0, "ME", "a"), (0, 2, "ME", "c")], "ts long, seq long, speaker string, text_raw string")
    out = {r.date: r.body for r in sinks.markdown_days(df).collect()}
    assert out["1970-01-01"].splitlines()[2:] == ["**00:00:00 ME**: c", "**00:00:04 ME**: a", "**00:00:05 Ann**: b"]


def test_unknown_reader():
    try:
        files.reader("nothing")
    except KeyError as e:
        assert "csv" in str(e)
    else:
        raise AssertionError
