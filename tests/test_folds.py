"""Rules over rows in order, with conversations cut into pieces, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import folds, timeline


def plain_rapid(rows, within=60, rapid=10, most=20):
    """The merge rule over the whole open group."""
    groups = []
    for r in rows:
        last = groups[-1][-1] if groups else None
        ok = last is not None and last[3] == r[3] and last[4] == r[4] == "text" and r[2] - last[2] <= within and "!!" not in last[5] + r[5][:1] and "!!" not in r[5]
        trial = [*groups[-1], r] if ok else []
        if ok and not (all(len(x[5]) <= most for x in trial) and all(b[2] - a[2] <= rapid for a, b in zip(trial, trial[1:]))):
            groups[-1].append(r)
        else:
            groups.append([r])
    return [(g[0][1], len(g), g[0][5] if len(g) == 1 else " | ".join(x[5] for x in g)) for g in groups]


def plain_segments(rows, least, most, gap=21600, shift=0.5):
    segments = [[]]
    for r in rows:
        now = segments[-1]
        if now and (len(now) >= most or (len(now) >= least and (r[2] - now[-1][2] >= gap or abs(r[6] - now[-1][6]) >= shift))):
            segments.append([])
        segments[-1].append(r)
    if len(segments[-1]) < least:
        tail = segments.pop()
        if segments and len(segments[-1]) + len(tail) <= most:
            segments[-1] += tail
    return [len(s) for s in segments]


@pytest.fixture
def in_pieces(spark):
    """Small tables stay in as many pieces as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def conversations(seed):
    """One long conversation, some short ones, one of a single row."""
    rng, rows = random.Random(seed), []
    for conv, n in [("long", 700), *[(f"c{i}", rng.randrange(1, 40)) for i in range(15)], ("z", 1)]:
        ts = 0
        for seq in range(n):
            ts += rng.choice([1, 3, 9, 11, 50, 70, 30000])
            rows.append((conv, seq * 3, ts, rng.choice(["ME", "ME", "OTHER"]), rng.choice(["text"] * 9 + ["image"]), "x" * rng.choice([1, 2, 15, 25]) + rng.choice(["", "", "", "!!"]), rng.choice([-1.0, 0.0, 0.2, 0.6])))
    return rows


SCHEMA = "conv_id string, seq long, ts long, speaker string, modality string, text_raw string, sentiment double"


def test_last_known_goes_on_over_pieces(spark, in_pieces):
    rng = random.Random(1)
    rows = [(c, i, rng.choice([None] * 30 + [i])) for c in ("a", None, "b") for i in range(300)]
    dealt = folds.dealt(spark.createDataFrame(rows, "c string, i int, v int").repartition(5), "c", ["i"])
    assert dealt.select(folds.PIECE).distinct().count() > 5
    got = {(r.c, r.i): (r.now, r.earlier) for r in folds.last_known(folds.last_known(dealt, "c", {"now": F.col("v")}, True), "c", {"earlier": F.col("v")}, False).collect()}
    for c in ("a", None, "b"):
        last = None
        for _, i, v in (r for r in rows if r[0] == c):
            before, last = last, v if v is not None else last
            assert got[c, i] == (last, before)


@pytest.mark.parametrize("seed", range(3))
def test_rapid_fire_in_pieces(spark, in_pieces, seed):
    rows = conversations(seed)
    got = timeline.merge_rapid_fire(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    for conv in {r[0] for r in rows}:
        assert sorted((r.seq, r.merged_count, r.text_raw) for r in got if r.conv_id == conv) == plain_rapid([r for r in rows if r[0] == conv])


@pytest.mark.parametrize("least, most", [(4, 9), (1, 1), (10, 20), (3, 500)])
def test_segments_in_pieces(spark, in_pieces, least, most):
    rows = conversations(7)
    got = timeline.segment_by_events(spark.createDataFrame(rows, SCHEMA).repartition(6), least, most).collect()
    assert len(got) == len(rows)
    for conv in {r[0] for r in rows}:
        sizes = {}
        for r in got:
            if r.conv_id == conv and r.segment is not None:
                sizes[r.segment] = sizes.get(r.segment, 0) + 1
        assert [sizes[k] for k in sorted(sizes)] == plain_segments([r for r in rows if r[0] == conv], least, most)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert timeline.segment_by_events(empty).collect() == [] and timeline.merge_rapid_fire(empty).collect() == []
