"""Queries whose keys grow beyond those of the supplied tables, and plans that must not grow faster than their input."""

import os
import random
import shutil

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

import __spark_entry__
from parley.operators import names, search


@pytest.fixture
def shifted(spark, sf, tmp_path):
    """The tables with conversations of ids that shift makes from the supplied ones."""

    def make(shift):
        folder = str(tmp_path / "sf")
        os.makedirs(folder)
        for f in os.listdir(sf):
            if f != "conversations.parquet":
                shutil.copy(f"{sf}/{f}", f"{folder}/{f}")
        spark.read.parquet(f"{sf}/conversations.parquet").withColumn("conv_id", shift(F.col("conv_id"))).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
        return folder

    return make


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("conversations", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, folder).select(*columns).collect()
    key = lambda r: tuple((v is None, round(v, 9) if isinstance(v, float) else v) for v in r)
    got, want = sorted(map(key, got)), sorted(map(key, want.fetchall()))
    assert got and got == want


def test_an_index_is_searched_in_groups(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8))
    x[::7] = x[0]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 8)]
    index = search.build_index(spark.createDataFrame(rows, "id long, embedding array<double>"), f"file://{tmp_path}/cells", 3)
    monkeypatch.setattr(search, "CELL_ROWS", 100)
    monkeypatch.setattr(search, "CELL_QUERIES", 7)
    asked = spark.createDataFrame(rows[:20], "query_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in search.search_index(index, asked, "id", 5, 3).collect()}
    assert len(got) == 100
    for q in range(20):
        s = np.array([(x[q] * r).sum() / np.sqrt((x[q] * x[q]).sum() * (r * r).sum()) for r in x])
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        assert [got[q, i + 1][0] for i in range(5)] == best.tolist() and np.allclose([got[q, i + 1][1] for i in range(5)], s[best])


def test_chat_years_beyond_two_digits(spark, shifted):
    same_as_sql(spark, shifted(lambda c: c + 40_000), "chat_read_back")


def test_repetitive_texts_are_not_shuffled(spark, sf, capsys):
    __spark_entry__.queries()["repetitive_text"](spark, sf).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_rows_of_one_chunk_count_each(spark, shifted):
    same_as_sql(spark, shifted(lambda c: c + 20_000), "smart_search")  # chunk ids are cut to six digits


@pytest.mark.parametrize("weighted", [False, True])
def test_documents_are_scored_where_they_are(spark, weighted, capsys):
    rng = random.Random(8)
    docs = [(i, [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randrange(0, 30))] if i % 11 else None) for i in range(3000)]
    queries = [(q, [f"w{rng.randrange(1, 90)}" for _ in range(6)]) for q in range(30)] + [(30, ["nowhere"]), (31, []), (32, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(5), spark.createDataFrame(queries, "query_id long, tokens array<string>")
    weight = F.floor(16 * F.log(1 + 600 / F.col("df")) * F.col("tf")) + 1 if weighted else None
    out = search.keyword_best(d, q, 4, weight)
    got = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in out.collect())
    assert len(got) == 120 and got == sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in search.keyword_top(search.keyword_index(d, weight), q, 4).collect())
    out.explain()
    assert "Generate" not in capsys.readouterr().out  # no row for each token of a document


def test_hits_are_held_for_a_piece_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(names, "PIECE", 3000)
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(50)] + [(50, None), (51, "y" * 9000)], "i int, t string").coalesce(1)
    size = lambda have: {"n": pa.array([len(have["t"])] * len(have["t"]), pa.int32())}
    out = names._by_piece(df, "t", StructType([*df.schema, StructField("n", IntegerType())]), size).collect()
    assert [(r.i, len(r.t or "")) for r in out] == [(i, 1000) for i in range(50)] + [(50, 0), (51, 9000)] and max(r.n for r in out) == 3


def test_near_pairs_are_read_by_and_by(spark, monkeypatch, capsys):
    monkeypatch.setattr(search, "DEALT", 7)
    monkeypatch.setattr(search, "HELD", 50)
    x = np.random.default_rng(4).normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    out = search.similar_pairs(df, "id", "v", 0.3, 40)
    assert {(r.a, r.b) for r in out.collect()} == {(i, j) for i, j in zip(*np.nonzero(s >= 0.3)) if i < j}
    out.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out  # no group is a table in memory


def test_each_task_keeps_the_best_pairs(spark):
    x = np.random.default_rng(5).normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    out = search.similar_pairs(df, "id", "v", 0.1, 50, best=5)
    i, j = np.triu_indices(400, 1)
    first = np.argsort(-(x @ x.T)[i, j])[:5]
    rows = sorted(out.collect(), key=lambda r: -r.similarity)
    assert [(r.a, r.b) for r in rows[:5]] == list(zip(i[first], j[first])) and len(rows) <= 5 * out.rdd.getNumPartitions()
