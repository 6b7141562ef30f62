"""Product codes of vectors by Lloyd's rounds with Elkan's bounds, in integers.

Every part of a row keeps an upper bound of the distance to its entry and a lower bound of the distance to each entry of
the codebook. When entries move, the bounds are shifted by the movement; an entry is passed over only if the triangle
inequality shows it to be strictly farther, and what is left is compared in integers, so ties fall as in a full search.
The bounds are part of a written table, so a lost executor repeats one round of its rows and not all rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import textkit, vectors
from parley.llm.scratch import Scratch

#: Bounds are moved apart by this share, far more than the rounding of a square root.
SLACK = 1e-9
#: A lower bound is a byte, a number of steps rounded down; this many steps reach between the farthest two entries.
STEPS = 200
#: Differences of components that a task holds at once.
SLICE = 1 << 22
STATE = "vec_id long, label string, v array<long>, code binary, upper binary, lower binary"


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, exact in 64 bits."""
    d = x - y
    return (d * d).sum(axis=-1)


def full_search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bounds) of each row of `x` from all distances; ties go to the lower entry."""
    d2 = squares(x[:, None, :], book[None])
    code = d2.argmin(axis=1)
    root = np.sqrt(d2.astype(np.float64))
    return code, root[np.arange(len(x)), code] * (1 + SLACK), root * (1 - SLACK)


def bounded_search(x: np.ndarray, book: np.ndarray, half: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same entries as full_search from bounds that hold for `book`: (entry, upper, lower, distances computed).

    `half` has half the distance between any two entries, not above the true value. An entry is left out only if its
    lower bound, or half its distance to the row's entry, is strictly above the upper bound.
    """
    code, upper, lower = code.copy(), upper.copy(), lower.copy()
    nearest = np.where(np.eye(len(book), dtype=bool), np.inf, half).min(axis=1)
    rows = np.flatnonzero(upper >= nearest[code])
    own = squares(x[rows], book[code[rows]])
    upper[rows] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    may = (lower[rows] <= upper[rows, None]) & (half[code[rows]] <= upper[rows, None])
    may[np.arange(len(rows)), code[rows]] = False
    r, j = np.nonzero(may)
    if len(r):
        d2 = squares(x[rows[r]], book[j])
        lower[rows[r], j] = np.sqrt(d2.astype(np.float64)) * (1 - SLACK)
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        least = np.minimum.reduceat(d2, first)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(r)]))
        hit = np.flatnonzero(d2 == least[group])
        hit = hit[np.r_[True, group[hit][1:] != group[hit][:-1]]]  # the lowest entry at the least distance
        at, entry = r[first], j[hit]
        better = (least < own[at]) | ((least == own[at]) & (entry < code[rows[at]]))
        at, entry, least = at[better], entry[better], least[better]
        moved = rows[at]
        lower[moved, code[moved]] = np.sqrt(own[at].astype(np.float64)) * (1 - SLACK)
        code[moved], upper[moved] = entry, np.sqrt(least.astype(np.float64)) * (1 + SLACK)
    return code, upper, lower, len(rows) + len(r)


def _up(upper: np.ndarray) -> np.ndarray:
    return np.nextafter(upper.astype(np.float32), np.float32(np.inf))


def _slices(batch: pa.RecordBatch, width: int, entries: int):
    """Slices of a batch whose distances fit in memory, each with its rows as a matrix."""
    step = max(1, SLICE // max(1, entries * width))
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield part, vectors.rows_of(part.column("v"), width)


def _assign_task(books, steps: np.ndarray, moves: np.ndarray | None, final: bool):
    """Assignment of the rows of a task; the first (`moves` is None) by full search, later ones by their bounds."""
    parts, entries, w = books.shape
    halves = np.sqrt(squares(books[:, :, None, :], books[:, None, :, :]).astype(np.float64)) * (0.5 * (1 - SLACK))
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string())] + ([("code", pa.string()), ("error", pa.int64())] if final else [("v", pa.list_(pa.int64())), ("code", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary())]))

    def run(batches):
        for batch in batches:
            for rows, x in _slices(batch, parts * w, entries):
                n = rows.num_rows
                x = x.reshape(n, parts, w)
                code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts, entries), np.uint8)
                if moves is not None:
                    code[:] = textkit.matrix(rows.column("code"), parts)
                    upper[:] = textkit.matrix(rows.column("upper"), parts * 4).copy().view(np.float32)
                    lower[:] = textkit.matrix(rows.column("lower"), parts * entries).reshape(n, parts, entries)
                for p in range(parts):
                    if moves is None:
                        code[:, p], upper[:, p], low = full_search(x[:, p], books[p])
                    else:
                        shifted = np.maximum(lower[:, p] * steps[p] * (1 - SLACK) - moves[p], 0.0)
                        code[:, p], upper[:, p], low, _ = bounded_search(x[:, p], books[p], halves[p], code[:, p], (upper[:, p] + moves[p][code[:, p]]) * (1 + SLACK), shifted)
                    if not final:
                        lower[:, p] = np.minimum(low / (steps[p] * (1 + SLACK)), 255)
                ids, labels = rows.column("vec_id"), rows.column("label")
                if final:
                    error = squares(x, books[np.arange(parts)[None], code]).sum(axis=1)
                    out = [ids, labels, pa.array([r.tobytes().hex() for r in code.astype(np.uint8)]), pa.array(error)]
                else:
                    bounds = np.ascontiguousarray(_up(upper)).view(np.uint8).reshape(n, parts * 4)
                    out = [ids, labels, rows.column("v"), textkit.binary(code.astype(np.uint8)), textkit.binary(bounds), textkit.binary(lower.reshape(n, parts * entries))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _sum_task(parts: int, entries: int, w: int):
    """Sums and counts of the rows of a task by part, entry and place: one row for each."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches):
        total, n = np.zeros((parts, entries, w), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = vectors.rows_of(batch.column("v"), parts * w).reshape(-1, parts, w)
            code = textkit.matrix(batch.column("code"), parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                n[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(n)
        at = [np.repeat(p, w), np.repeat(e, w), np.tile(np.arange(w), len(p)), np.repeat(n[p, e], w), total[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(at, schema)], schema=schema)

    return run


def elkan_codes(spark: SparkSession, table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the rows of `table` (vec_id, embedding, label).

    Components become floor(scale * x); a vector is cut into `parts` equal consecutive parts, and each part position has a
    codebook that starts as that part of the `entries` smallest vec_ids. Each round assigns every part to its nearest entry
    (squared distance, ties to the lower entry) and moves each entry to the floor of the mean of its parts; unused entries
    stay. After the last round parts are assigned once more: `code` has two hex digits a part, `error` the sum of the
    squared distances, `label_error` that of all rows of an equal label, nulls together.

    Rows whose vector is null or holds null or non-finite components are dropped; all others are coded. A vector shorter
    than the longest, rounded up to a multiple of `parts`, reads as followed by zeros, an empty one as zeros. Rows that
    repeat a vec_id each have a row of the result; among the first entries they stand in the order of their components.
    Null vec_ids are coded and come last among these. With fewer rows than `entries` codebooks are smaller; an empty table
    gives an empty result. Other columns of the input are left out. Sums must fit in 64 bits: larger components raise
    ValueError before any work.

    Collected to the driver: the first entries and a sum for each entry and place, so `entries` times the length of a
    vector. A row's bounds are parts * entries bytes.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry is a byte: 1 to 256 entries")
    scratch = Scratch(spark, "codebooks")
    kept = table.where(vectors.finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    n, longest, most = vectors.extent(kept, "embedding", scale)
    w = max(1, -(-longest // parts))
    if w * parts * (2 * most) ** 2 >= 1 << 62 or n * most >= 1 << 62:
        raise ValueError(f"components up to {most} in vectors of {longest} give sums beyond 64 bits")
    rows = scratch.write(kept.select("vec_id", "label", vectors.padded(vectors.whole("embedding", scale), w * parts).alias("v")), "rows")
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, w).transpose(1, 0, 2).copy()
    if not n:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long, label_error long, codebooks_sha256 string")
    steps = np.maximum(np.sqrt(squares(books[:, :, None, :], books[:, None, :, :]).max(axis=(1, 2)).astype(np.float64)), 1.0) / STEPS
    state, moves = rows, None
    for _ in range(rounds):
        now = scratch.write(state.mapInArrow(_assign_task(books, steps, moves, False), STATE), "state")
        scratch.drop(state)
        sums = now.select("v", "code").mapInArrow(_sum_task(parts, len(first), w), "part int, entry int, place int, n long, total long")
        state, old, books = now, books, books.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # a row for each value of the codebooks
            books[r.part, r.entry, r.place] = r.total // r.n
        moves = np.sqrt(squares(books, old).astype(np.float64)) * (1 + SLACK)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = scratch.write(state.mapInArrow(_assign_task(books, steps, moves, True), "vec_id long, label string, code string, error long"), "coded")
    scratch.close(coded)
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
