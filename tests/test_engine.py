"""The surface, retrieval, rule scores and model shells."""

import datetime
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import dates
from parley.operators import inference, retrieval, scoring
from parley.plans.engine import Engine
from parley.sources import datasets

DAY1 = datetime.date(2025, 6, 8)


@pytest.mark.parametrize("text, days", [("第5天到第7天", [5, 6, 7]), ("第3-4天", [3, 4]), ("最近3天", [98, 99, 100]), ("上周", list(range(94, 101))), ("第12天怎么了", [12]), ("2025年6月9日", [2]), ("6月9日到6月11日", [2, 3, 4]), ("2025-06-10", [3]), ("hello", []), ("第900天", []), ("6月9日至11日", [2, 3, 4]), ("2025-06-09 ~ 2025-06-10", [2, 3]), ("最近2周", list(range(87, 101))), ("最近一个月", list(range(71, 101))), ("上个月", list(range(71, 101))), ("最后两周", list(range(87, 101))), ("最近1个月和第3天", list(range(71, 101))), ("第7天到第5天", [5, 7]), ("第3天 和 2025年6月9日", [3]), ("6月31日", []), ("2月", []), ("第95天到第200天", list(range(95, 131))), ("最近", [])])
def test_query_days(text, days):
    assert dates.query_days(text, DAY1, 100) == days


def test_days_to_dates(spark):
    df = spark.createDataFrame([("第1天 and 第12天",), (None,)], "t string")
    assert [r.x for r in df.select(dates.days_to_dates("t", "2025-06-08").alias("x")).collect()] == ["2025-06-08 and 2025-06-19", ""]


def test_ingest_and_export(spark, tmp_path):
    engine = Engine(spark)
    (tmp_path / "a.csv").write_text("t,w,x\n5,Ann,hi\n3,Bob,yo\n0,Bob,bad time\n")
    manifest = datasets.Manifest.read({"source_type": "csv", "input_paths": [str(tmp_path / "a.csv")], "participants": {"Ann": "ME", "Bob": "OTHER:Bob"}, "mapping": {"t": "ts", "w": "speaker", "x": "text_raw", "_const:1": "type", "_const:text": "modality"}})
    good, bad = engine.ingest(manifest)
    assert [(r.msg_uid, r.ts, r.speaker) for r in good.collect()] == [("CSV:2", 3, "OTHER:Bob"), ("CSV:1", 5, "ME")]
    assert [r.errors for r in bad.collect()] == [["ts"]]
    assert {r.dimension for r in engine.report(good).collect()} == {"modality", "speaker", "date", "total"}
    engine.export(good, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).count() == 2
    with pytest.raises(ValueError):
        datasets.Manifest.read({"source_type": "csv"})
    assert engine.schema().where("required").count() == 6 and "telegram" in engine.readers()


def test_search_precedence(spark):
    df = spark.createDataFrame([("c1", "apple pie", [1, 2], "x"), ("c2", "apple", [3], "y"), ("c3", "pie", [2], "x")], "chunk_id string, text string, days array<int>, type string")
    engine = Engine(spark)
    ids = lambda **a: [r.chunk_id for r in engine.search(df, **a).collect()]
    assert ids(day=2, words=["apple"]) == ["c1", "c3"] and ids(days=(3, 9)) == ["c2"] and ids(words=["apple", "pie"]) == ["c1", "c2", "c3"] and ids(words=["pie"], kind="y") == []


def test_leaderboard_honours_mode(spark):
    df = spark.createDataFrame([("a", "b", "a_win", "m1"), ("a", "b", "b_win", "m2"), ("b", "a", "b_win", "m1")], "model_a string, model_b string, vote string, mode string")
    assert [r.model for r in Engine(spark).leaderboard(df, "m1").collect()] == ["a", "b"]


def test_cells_find_most_neighbours(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    indexed, centres = retrieval.index_cells(e, 8)
    rows = e.collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = {rows[i].vec_id for i in np.argsort(-(x @ x[0]))[:10]}
    assert len(best & {r.vec_id for r in retrieval.search_cells(indexed, centres, list(rows[0].embedding), 6, 10, "vec_id").collect()}) >= 8


def test_context_and_boost(spark):
    df = spark.createDataFrame([("a", "x red", 1.0), ("b", "y", 1.1)], "id string, t string, score double")
    assert [round(r.score, 6) for r in retrieval.boost(df, "t", ["red"]).collect()] == [1.2, 1.1]
    assert df.select(retrieval.context({"A": F.col("t"), "B": F.lit("")}).alias("c")).first().c == "## A\nx red"


def test_voice_summary(spark):
    df = spark.createDataFrame([("你好", "语气平静，没有什么特别的地方可以说明，整段都是这样的"), ("你好", "根据语音内容，可以感受到说话人非常开心，语速较快，声音洪亮，带着期待的语气")], "t string, a string")
    out = scoring.voice_summary(df, "t", "a").collect()
    assert out[0].analysis_summary is None and "开心" in out[1].analysis_summary and out[1].compression_ratio > 1


def test_sticker_intent(spark):
    df = spark.createDataFrame([("a cat waves", "bye"), ("a cat waves", ""), ("?", "")], "c string, o string")
    rule = scoring.sticker_intent("c", "o", {"farewell": ["bye"]}, [(0.8, {"greeting": ["waves"]})])
    assert [(r.x.intent, r.x.confidence) for r in df.select(rule.alias("x")).collect()] == [("farewell", 0.95), ("greeting", 0.8), ("other", 0.3)]


def test_model_shell(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None)], "k long, t string").coalesce(1)

    def make():
        def model(texts):
            if "boom" in texts:
                raise RuntimeError("no")
            return [t.upper() for t in texts]

        return model

    out = {r.k: (r.output, r.error) for r in inference.apply_model(df, "k", "t", make, batch=1).collect()}
    assert out == {1: ("A", None), 2: (None, "RuntimeError: no"), 3: ("", None)}
    done = spark.createDataFrame([(1, None), (2, "x")], "k long, error string")
    assert sorted(r.k for r in inference.resume(df, done, "k").collect()) == [2, 3]


def test_output_parsing(spark):
    df = spark.createDataFrame([('<think>x</think>{"level": "high", "items": ["a"]}',), ("none",), ('{"level": "odd", "items": []}',)], "o string")
    parsed = df.withColumn("p", inference.parse("o", "level string, items array<string>"))
    assert [r.problems for r in inference.checked(parsed, "p", {"level": ["high", "low"]}, {"items": (1, 3)}).collect()] == [[], ["missing"], ["level", "items"]]
    marks = spark.createDataFrame([("<|HAPPY|><|Speech|>hi",)], "t string").select(inference.tags("t").alias("a"), inference.without_tags("t").alias("b")).first()
    assert marks.a == ["HAPPY", "Speech"] and marks.b == "hi"
    assert spark.createDataFrame([("Confidence: 80%",)], "t string").select(inference.confidence("t").alias("c")).first().c == 0.8


def test_frame_maxima(spark):
    df = spark.createDataFrame([([(0.1, 0.2), (0.9, 0.1)],)], "s array<struct<nsfw: double, gore: double>>")
    x = df.select(inference.frame_maxima("s", ["nsfw", "gore"], {"nsfw": 0.5}).alias("x")).first().x
    assert (x.nsfw, x.gore, x.frames) == (0.9, 0.2, [1])


def test_document_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x/y.txt", "1")
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p>")
    (tmp_path / "c.docx").write_bytes(body.getvalue())
    (tmp_path / "d.zip").write_bytes(b"broken")
    out = {r.path.rpartition("/")[2]: r.text for r in datasets.document_texts(spark, str(tmp_path)).collect()}
    assert out == {"a.txt": "hello", "b.zip": "x/y.txt", "c.docx": "one\ntwo", "d.zip": None}


def test_connector(spark):
    spark.dataSource.register(datasets.MessageSource)
    df = spark.read.format("messages").option("rows", "9").option("parts", "3").load()
    assert df.count() == 9 and df.select("msg_uid").distinct().count() == 9


def test_source_type():
    assert datasets.source_type(["a.html", "a.csv"]) == "html" and datasets.source_type(["result.json"]) == "telegram" and datasets.source_type(["x.png"]) is None
    assert datasets.file_pairs(["b.csv", "a.html", "a.csv"]) == ("a.html", "a.csv")


def test_dialogues(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"messages": [{"role": "Client", "content": "hi"}, {"role": "x", "content": "?"}, {"role": "counselor", "content": "yes"}]}\n')
    assert datasets.dialogues(spark, str(tmp_path), "s").first().conversation == "ME: hi\nOTHER: yes"
