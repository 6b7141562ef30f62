"""Product codes and hard negatives against full searches, with the odd rows of their docstrings."""

import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("parley.llm")
from pyspark.sql import functions as F  # noqa: E402

from parley.llm import codebooks, hard_negatives  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, code string, rank string, score double"


def table(seed=3, n=260, d=8):
    """Clustered vectors with ties, copies, a hot vector, short, empty, null and non-finite ones, repeated and null ids."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = centres[7] if i % 3 == 0 else [x + rng.choice([0, 0, 0.01, -0.2, 0.3]) for x in rng.choice(centres)]
        rows.append((i, v, rng.choice([0, 1, 1, 2, None])))
    rows += [(5, rows[9][1], 1), (5, rows[9][1], 1), (None, rows[3][1], 2), (900, None, 1), (901, [1.0] * (d - 1) + [None], 1), (902, [math.nan] * d, 1), (903, [math.inf] + [0.0] * (d - 1), 2), (904, [], 1), (950, rows[1][1][:3], 2), (951, [0.0] * d, None)]
    return [(*r, "x", "y", None) for r in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(5).cache()


def whole(v, d):
    """floor(256 x) of a vector that takes part, else None; the floats are those of single precision."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (d - len(v))


def lloyd(rows, parts, entries, rounds, d):
    """Plain rounds: every part against every entry."""
    kept = [(r[0], w, r[2]) for r in rows if (w := whole(r[1], d)) is not None]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    w = d // parts
    cut = [[r[1][p * w : p * w + w] for p in range(parts)] for r in kept]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(x[p], books[p])[1] for x in cut]
            for e in range(len(first)):
                members = [x[p] for x, o in zip(cut, own) if o == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out, by_label = [], {}
    for (i, _, label), x in zip(kept, cut):
        got = [near(x[p], books[p]) for p in range(parts)]
        error = sum(g[0] for g in got)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{g[1]:02x}" for g in got), error, label))
    digest = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("parts, entries, rounds", [(4, 16, 2), (2, 64, 4), (8, 3, 1), (4, 16, 0)])
def test_codes_equal_a_full_search(spark, vectors, parts, entries, rounds):
    got = codebooks.elkan_codes(spark, vectors, parts, entries, rounds).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == lloyd(table(), parts, entries, rounds, 8)


def test_codes_of_lengths_that_parts_do_not_divide(spark, vectors):
    got = codebooks.elkan_codes(spark, vectors, 3, 5, 2).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == lloyd(table(), 3, 5, 2, 9)


def test_codes_of_few_rows_and_limits(spark, vectors):
    assert codebooks.elkan_codes(spark, vectors.limit(0)).count() == 0
    assert codebooks.elkan_codes(spark, vectors.where("vec_id >= 900 and vec_id < 904")).count() == 0
    one = codebooks.elkan_codes(spark, vectors.where("vec_id = 7"), 4).collect()
    assert [(r.code, r.error) for r in one] == [("00000000", 0)]
    empty = codebooks.elkan_codes(spark, vectors.where("vec_id = 904"), 4).collect()
    assert [(r.code, r.error) for r in empty] == [("00000000", 0)]
    with pytest.raises(ValueError):
        codebooks.elkan_codes(spark, spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<float>, label int"))


def test_bounds_prune_and_stay_true():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-40, 40, (3000, 4)), rng.integers(-300, 300, (20, 4)), np.zeros((5, 4), np.int64)])
    book = x[rng.permutation(len(x))[:64]]
    code, upper, lower = codebooks.full_search(x, book)
    for _ in range(4):
        new = np.array([x[code == e].sum(axis=0) // max(1, (code == e).sum()) if (code == e).any() else book[e] for e in range(len(book))])
        move = np.sqrt(codebooks.squares(new, book).astype(float)) * (1 + codebooks.SLACK)
        book = new
        half = np.sqrt(codebooks.squares(book[:, None], book[None]).astype(float)) * 0.5 * (1 - codebooks.SLACK)
        code, upper, lower, computed = codebooks.bounded_search(x, book, half, code, upper + move[code], np.maximum(lower - move, 0))
        want = codebooks.full_search(x, book)
        true = np.sqrt(codebooks.squares(x[:, None], book[None]).astype(float))
        assert (code == want[0]).all() and (true[np.arange(len(x)), code] <= upper).all() and (lower <= true).all()
        assert computed < 0.5 * len(x) * len(book)


def negatives(rows, anchors, d, positives=5, k=3):
    """Every anchor against every row."""
    by_id = {}
    for r in rows:
        w = whole(r[1], d)
        if r[0] is not None and r[2] is not None and w is not None:
            by_id[r[0]] = min(by_id.get(r[0], (r[2], w)), (r[2], w))
    out = []
    for a in anchors & set(by_id):
        label, v = by_id[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in by_id.items() if i != a)
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(i, -s) for s, i, other in scored if other != label and 50 * -score <= 100 * -s <= 95 * -score][:k]
            out += [(a, p, r + 1, i, -score, s) for r, (i, s) in enumerate(fit)]
    return sorted(out)


def test_negatives_equal_a_full_search(spark, vectors, monkeypatch):
    anchors = {i for i in range(0, 960, 5)}
    asked = spark.createDataFrame([(i,) for i in anchors] + [(None,), (0,)], "vec_id long")
    want = negatives(table(), anchors, 8)
    assert len(want) > 100
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(spark, vectors, asked).collect()) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 8 * (8 + 4 * 5 * 4) * 50)  # 50 anchors a block
    monkeypatch.setattr(hard_negatives, "SCORES", 100)
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(spark, vectors, asked).collect()) == want


def test_negatives_of_nothing_and_limits(spark, vectors):
    asked = vectors.select("vec_id")
    assert hard_negatives.hard_negatives(spark, vectors.limit(0), asked).collect() == []
    assert hard_negatives.hard_negatives(spark, vectors, asked.limit(0)).collect() == []
    assert hard_negatives.hard_negatives(spark, vectors.where("label = 1"), asked).collect() == []
    assert hard_negatives.hard_negatives(spark, vectors.where("vec_id = 904"), asked).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark, vectors.withColumn("embedding", F.transform("embedding", lambda x: x * 1e8)), asked)
