"""Hard negatives by blocked dense products: blocks of anchors are broadcast and multiplied with blocks of candidates.

Scores are integers in double precision, exact below 2^53. A first pass keeps the best rows of the anchor's label, small
lists that merge in any order; a second one keeps, for each of these positives, the best rows of other labels whose score
lies in the window that the positive sets. No pass moves the candidates: only the lists are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm import vectors
from parley.llm.scratch import Scratch

#: Bytes of a block of anchors, the most that is broadcast at once; scores that a task holds at once.
BLOCK_BYTES, SCORES = 1 << 25, 1 << 21
NONE = -np.inf


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k largest of each row, -inf where there are fewer; `ids` ascend, so ties go to the smaller."""
    rows = np.arange(len(score))
    values, found = np.full((len(score), k), NONE), np.zeros((len(score), k), np.int64)
    at = np.zeros((len(score), k), np.int64)
    for i in range(min(k, score.shape[1])):
        at[:, i] = score.argmax(axis=1)
        values[:, i] = score[rows, at[:, i]]
        found[:, i] = ids[at[:, i]]
        score[rows, at[:, i]] = NONE
    for i in reversed(range(min(k, score.shape[1]))):
        score[rows, at[:, i]] = values[:, i]
    return values, found


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best of two lists of equal length by score, ties by id."""
    k = a[0].shape[-1]
    score, ids = np.concatenate([a[0], b[0]], axis=-1), np.concatenate([a[1], b[1]], axis=-1)
    order = np.lexsort((ids, -score), axis=-1)[..., :k]
    return np.take_along_axis(score, order, axis=-1), np.take_along_axis(ids, order, axis=-1)


def _candidates(batches, width: int):
    """(ids, labels, vectors) of the batches of a task, by vec_id within a batch."""
    for batch in batches:
        if batch.num_rows:
            ids = batch.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], batch.column("label").to_numpy()[order], vectors.rows_of(batch.column("v"), width)[order].astype(np.float64)


def _positives_task(anchors, k: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        ids, labels, x = anchors.value
        best = np.full((len(ids), k), NONE), np.zeros((len(ids), k), np.int64)
        for cand, kinds, y in _candidates(batches, x.shape[1]):
            for kind in np.intersect1d(labels, kinds):
                rows, cols = np.flatnonzero(labels == kind), np.flatnonzero(kinds == kind)
                step = max(1, SCORES // len(cols))
                for at in (rows[i : i + step] for i in range(0, len(rows), step)):
                    score = x[at] @ y[cols].T
                    score[ids[at][:, None] == cand[cols][None, :]] = NONE
                    best[0][at], best[1][at] = _merge((best[0][at], best[1][at]), _best(score, cand[cols], k))
        a, i = np.nonzero(best[0] > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(best[1][a, i]), pa.array(best[0][a, i].astype(np.int64))], schema=schema)

    return run


def _negatives_task(anchors, k: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def run(batches):
        ids, labels, x, positive, value, low, high = anchors.value
        m = high.shape[1]
        best = np.full((len(ids), m, k), NONE), np.zeros((len(ids), m, k), np.int64)
        for cand, kinds, y in _candidates(batches, x.shape[1]):
            step = max(1, SCORES // len(cand))
            for lo in range(0, len(ids), step):
                at = slice(lo, lo + step)
                score = x[at] @ y.T
                score[labels[at][:, None] == kinds[None, :]] = NONE
                for w in range(m):  # windows by descending upper end, so what one leaves out the next does too
                    score[score > high[at, w : w + 1]] = NONE
                    near = np.flatnonzero(score.max(axis=1) >= np.maximum(best[0][at, w, -1], low[at, w]))
                    if len(near):
                        rows = lo + near
                        best[0][rows, w], best[1][rows, w] = _merge((best[0][rows, w], best[1][rows, w]), _best(score[near], cand, k))
        a, w, i = np.nonzero((best[0] > NONE) & (best[0] >= low[:, :, None]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[a], positive[a, w], value[a, w], best[1][a, w, i], best[0][a, w, i].astype(np.int64))], schema=schema)

    return run


def _anchor_blocks(anchors: DataFrame, size: int, width: int):
    """(ids, labels, vectors) of anchors, `size` of them at a time by vec_id: one block is on the driver at once."""
    last = None
    while True:
        left = anchors if last is None else anchors.where(F.col("vec_id") > last)
        block = left.orderBy("vec_id").limit(size).toArrow().combine_chunks()
        if not block.num_rows:
            return
        ids = block.column("vec_id").to_numpy()
        yield ids, block.column("label").to_numpy(), vectors.rows_of(block.column("v"), width).astype(np.float64)
        last = int(ids[-1])


def windows(ids: np.ndarray, found: pa.Table, m: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(positive ids, their scores, lower and upper ends) by anchor, best first; ends of missing positives admit nothing.

    A window is low * positive <= 100 * negative <= high * positive, ends rounded inwards in integers.
    """
    at = np.searchsorted(ids, found.column("anchor_id").to_numpy())
    rank = found.column("rank").to_numpy() - 1
    value, positive = np.zeros((len(ids), m), np.int64), np.zeros((len(ids), m), np.int64)
    lower, upper = np.full((len(ids), m), np.inf), np.full((len(ids), m), NONE)
    score = found.column("score").to_numpy()
    value[at, rank], positive[at, rank] = score, found.column("positive_id").to_numpy()
    lower[at, rank], upper[at, rank] = -(-low * score // 100), high * score // 100
    return positive, value, lower, upper


def hard_negatives(spark: SparkSession, table: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the vec_ids in `anchors`.

    `table` has vec_id, embedding and an integer label. A score is the inner product of vectors of floor(scale * x); larger
    ones come first, ties by smaller vec_id. An anchor's positives are its best `positives` other rows of the same label;
    for each, the best `negatives` rows of other labels with low * positive <= 100 * negative <= high * positive are
    returned. A positive with a score below 0 has an empty window.

    Rows with a null vec_id, label or vector, or with null or non-finite components take no part. Of rows that repeat a
    vec_id the one of the smallest label and vector counts. A shorter vector reads as followed by zeros. Anchors that take
    no part, and anchors without positives or negatives, have no rows; an empty table gives an empty result. Other columns
    are left out. Scores must stay below 2^53 / 100, where products and windows are exact: larger components raise
    ValueError before any work.

    Every anchor meets every row, in blocks: a block of anchors is at most 32 MB and is read in the order of vec_id, and
    each task keeps lists of fixed length for the anchors of the block.
    """
    scratch = Scratch(spark, "negatives")
    kept = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    _, width, most = vectors.extent(kept, "embedding", scale)
    width = max(1, width)
    if width * most**2 * 100 >= 1 << 53:
        raise ValueError(f"components up to {most} in vectors of {width} give scores that are not exact in double precision")
    whole = kept.select("vec_id", "label", vectors.padded(vectors.whole("embedding", scale), width).alias("v"))
    rows = scratch.write(whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"), "rows")
    asked = scratch.write(rows.join(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi"), "anchors")
    size = max(1, BLOCK_BYTES // (8 * (width + 4 * positives * (negatives + 1))))
    out = []
    for ids, labels, x in _anchor_blocks(asked, size, width):
        shared = spark.sparkContext.broadcast((ids, labels, x))
        lists = rows.mapInArrow(_positives_task(shared, positives), "anchor_id long, positive_id long, score long")
        rank = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
        found = lists.withColumn("rank", rank).where(F.col("rank") <= positives).toArrow()  # at most `positives` rows an anchor of the block
        shared.unpersist()
        shared = spark.sparkContext.broadcast((ids, labels, x, *windows(ids, found, positives, low, high)))
        lists = rows.mapInArrow(_negatives_task(shared, negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
        out.append(scratch.write(lists.withColumn("rank", rank).where(F.col("rank") <= negatives), "found"))
        shared.unpersist()
    scratch.close(*out)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(out[0].schema).parquet(*[path for _, path in scratch.tables]).select(*columns)
