"""Spans with places, names by a dictionary, dense numbers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parley.functions import spans
from parley.operators import names, numbering, privacy, timeline

PATTERNS = {"EMAIL": "[a-z]+@[a-z]+\\.[a-z]+", "NUM": "(?<!\\d)\\d{3,}(?!\\d)", "WORD": "[a-z]+\\.[a-z]{2,}"}


def texts(seed=1, n=200):
    rng = random.Random(seed)
    bits = ["a@b.cc", "b.cc", "123", "12", "1234567", "é", "\U0001f600", "x", " ", "  ", "zz@q.de.fr", ".", "王小明", "王小"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(n)]
    return out + [None, "", "123 " * 3000]


def plain_spans(text, overlaps):
    if overlaps == "first":
        named = "|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items())
        return [(m.start(), m.end(), m.lastgroup, m[0]) for m in re.finditer(named, text or "", re.A)]
    found = {}
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text or "", re.A):
            found.setdefault((m.start(), m.end()), (m.start(), m.end(), k, m[0]))
    every = sorted(found.values())
    if overlaps == "all":
        return every
    kept = []
    for s in sorted(every, key=lambda s: (s[0] - s[1], s[0])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


@pytest.mark.parametrize("overlaps", ["first", "all", "longest"])
def test_spans_have_their_places(spark, overlaps):
    rows = texts() if overlaps != "longest" else texts()[:-1]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: [tuple(s) for s in r.s] for r in df.select("i", spans.find_spans("t", PATTERNS, overlaps).alias("s")).collect()}
    assert got == {i: plain_spans(t, overlaps) for i, t in enumerate(rows)}


def test_of_equal_places_the_first_kind_counts(spark):
    both = {"WORD": "[a-z]+", "AB": "ab", "ANY": "[a-z0-9]+"}
    got = spark.createDataFrame([("x1 cd ab",)], "t string").select(spans.find_spans("t", both, "all").alias("s")).first().s
    assert [tuple(s) for s in got] == [(0, 1, "WORD", "x"), (0, 2, "ANY", "x1"), (3, 5, "WORD", "cd"), (6, 8, "WORD", "ab")]


def test_replacing_reads_once(spark):
    rows = texts(2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", privacy.redact("t", PATTERNS, {"NUM": "$1 123\\"}).alias("s")).collect()}
    for i, t in enumerate(rows):
        want = t
        for a, b, k, _ in reversed(plain_spans(t, "first")):
            want = want[:a] + {"NUM": "$1 123\\"}.get(k, f"[{k}]") + want[b:]
        assert got[i] == want


def naive_hits(text, words, exclude, around, borders, ignore_case):
    """Every name at every place, longest first."""
    low = (lambda s: s.lower()) if ignore_case else str
    found = []
    for a in range(len(text or "")):
        for w in words:
            b = a + len(w)
            if low(text[a:b]) != low(w) or b > len(text):
                continue
            word = lambda c: (c.isalnum() or c == "_") and not "一" <= c <= "鿿"
            if borders and (a and word(text[a - 1]) and word(text[a]) or b < len(text) and word(text[b - 1]) and word(text[b])):
                continue
            context = low(text[max(0, a - around) : b + around])
            if any(low(w) in low(x) and low(x) in context for x in exclude):
                continue
            found.append((a, b, w))
    kept = []
    for h in sorted(found, key=lambda h: (h[0] - h[1], h[0])):
        if all(h[1] <= k[0] or k[1] <= h[0] for k in kept):
            kept.append(h)
    return sorted(kept)


@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("borders, ignore_case", [(False, False), (True, True)])
def test_hits_equal_a_search_for_every_name(spark, monkeypatch, joined, borders, ignore_case):
    rng = random.Random(3)
    letters = "abAB王小 ,_é"
    words = list({w for _ in range(60) if (w := "".join(rng.choice(letters.strip()) for _ in range(rng.randrange(1, 5))).strip())})
    if ignore_case:
        words = list({w.lower(): w for w in words}.values())
    rows = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(150)] + [None, "", words[0]]
    exclude = [words[0] + "b", "a" + words[1], words[2]]
    if joined:
        monkeypatch.setattr(names, "MOST_CHARS", 0)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    table = spark.createDataFrame([(w, "c" + w) for w in words] + [(None, "x"), ("", "y"), (words[0], "d")], "text string, code string")
    got = names.name_hits(df, "i", "t", table, "h", exclude, 2, borders, ignore_case).collect()
    assert {r.i: [(h.start, h.end, h.name) for h in r.h] for r in got} == {i: naive_hits(t, words, exclude, 2, borders, ignore_case) for i, t in enumerate(rows)}
    assert all(h.code == "c" + h.name for r in got for h in r.h) and sum(len(r.h) for r in got) > 50


def test_many_names_cost_no_more_a_text(spark):
    words = spark.range(100_000).select(F.concat(F.lit("name"), "id").alias("text"), F.concat(F.lit("P"), "id").alias("code"))
    df = spark.createDataFrame([(1, "name7 met name77777 " + "and walked " * 20_000)], "i int, t string")
    out = names.replace_names(df, "i", "t", words).first()
    assert out.t.startswith("[P7] met [P77777] and") and out.replaced == 2


def test_confirmed_names_are_kept_in_versions(spark, tmp_path):
    texts = spark.createDataFrame([(1, "我见 王小明 了"), (2, "王小明 说"), (3, "李四 来"), (4, "高兴 王小明天见面了")], "id int, t string")
    judge = lambda c: c.withColumn("category", F.when(F.col("candidate") == "李四", "uncertain").when(F.col("candidate") == "王小明", "real_name").otherwise("common"))
    found = names.phase1(texts, "id", "t", ["王", "李", "高"], judge, ["高兴"])
    assert sorted((r.text, r.category, r.frequency, len(r.contexts)) for r in found.collect()) == [("李四", "uncertain", 1, 1), ("王小明", "real_name", 2, 2)]
    path = f"file://{tmp_path}/names"
    names.save_names(found, path, 1)
    more = spark.createDataFrame([("李四", "real_name", 5, "OTHER"), ("赵六", "real_name", 1, None)], "text string, category string, frequency long, alias string")
    names.save_names(names.remove_names(names.add_names(names.load_names(spark, path), more), spark.createDataFrame([("王小明",)], "text string")), path, 2)
    assert {r.text for r in names.load_names(spark, path).collect()} == {"李四", "赵六"}
    assert {r.text for r in names.load_names(spark, path, 1).collect()} == {"李四", "王小明"}
    assert [tuple(r) for r in names.alias_map(names.load_names(spark, path)).collect()] == [("李四", "OTHER")]
    coded = names.codes(names.add_names(names.load_names(spark, path, 1), more), me=["王小明"])
    assert {r.text: r.code for r in coded.collect()} == {"李四": "OTHER", "王小明": "ME", "赵六": "PERSON_1"}
    assert [r.t for r in names.replace_names(texts, "id", "t", coded).orderBy("id").collect()] == ["我见 [ME] 了", "[ME] 说", "[OTHER] 来", "高兴 [ME]天见面了"]


def test_numbers_are_dense_and_no_task_sees_all(spark, capsys):
    rng = random.Random(6)
    rows = [(rng.randrange(50), i, rng.choice("xyz")) for i in range(2000)] + [(None, 5000, "x")]
    df = spark.createDataFrame(rows, "a int, i int, c string").repartition(7)
    got = numbering.numbered(df, [F.desc_nulls_last("a"), "i"], "n", 10)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.i, r.c) for r in sorted(got.collect(), key=lambda r: r.n)] == want and sorted(r.n for r in got.collect()) == list(range(10, 2011))
    assert numbering.numbered(df.limit(0), ["i"]).collect() == []
    for out in (got, timeline.dense_ids(df, "c", "i"), privacy.pseudonyms(df, "c", "i")):
        out.explain("formatted")
        assert "Window" not in capsys.readouterr().out
