"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation with four-bit tables and exact reranking.

For a query of high inner product with a point the error parallel to the point costs most, so codewords minimise
eta * |parallel residual|^2 + |orthogonal residual|^2. Vectors are scaled to length one, so inner products are cosines.
A block of candidates is scanned with one table of 16 values per subspace and query; all that may be among the best of the
block, by the error of their codes, are scored exactly on the original vectors, and the best of all blocks remain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block of candidates and of queries; one task scans one pair of blocks.
BLOCK, QUERY_BLOCK = 16_384, 2_048
CODES = 16


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Codebooks of `parts` subspaces with 16 words each, fitted by alternating assignment and weighted least squares."""

    def __init__(self, sample: np.ndarray, parts: int, eta: float, rounds: int = 12, seed: int = 7):
        x = _directions(sample.astype(np.float64))
        n, d = x.shape
        self.cuts = [d * k // parts for k in range(parts + 1)]
        self.eta, rng = eta, np.random.default_rng(seed)
        pick = rng.permutation(n)
        self.books = [x[np.resize(pick, CODES), a:b].copy() for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        for _ in range(rounds):
            codes = self.encode(x)
            for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
                rest = x - self.decode(codes)
                rest[:, a:b] += self.books[k][codes[:, k]]  # what this subspace should give
                side = np.einsum("ij,ij->i", rest, x)  # parallel part of the wanted residual
                for c in range(CODES):
                    own = codes[:, k] == c
                    if own.any():
                        u = x[own, a:b]
                        left = own.sum() * np.eye(b - a) + (eta - 1) * u.T @ u
                        right = rest[own, a:b].sum(axis=0) + (eta - 1) * u.T @ side[own]
                        self.books[k][c] = np.linalg.solve(left, right)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit vectors: by plain distance first, then each subspace in turn against the anisotropic loss."""
        codes = np.stack([((x[:, None, a:b] - book[None]) ** 2).sum(axis=2).argmin(axis=1) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:])], axis=1)
        parallel = np.einsum("ij,ij->i", x - self.decode(codes), x)
        for k, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:])):
            u = x[:, a:b]
            inner = u @ book.T
            now = np.take_along_axis(inner, codes[:, k : k + 1], axis=1)[:, 0]
            side = (parallel + now)[:, None] - inner
            loss = ((u[:, None, :] - book[None]) ** 2).sum(axis=2) + (self.eta - 1) * side**2
            codes[:, k] = loss.argmin(axis=1)
            parallel = np.take_along_axis(side, codes[:, k : k + 1], axis=1)[:, 0]
        return codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with each codeword: queries x parts x 16."""
        return np.stack([q[:, a:b] @ book.T for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:])], axis=1).astype(np.float32)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((y * y).sum(axis=-1)))


def _scan_task(quantiser, k: int, rerank: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, qids = candidates.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        x, q = (np.stack(t.column("v").to_numpy(zero_copy_only=False)).astype(np.float64) for t in (candidates, queries))
        ux, uq = _directions(x), _directions(q)
        codes = quantiser.value.encode(ux)
        # a table score is off by no more than the length of what the code leaves out, and by rounding
        off = np.linalg.norm(ux - quantiser.value.decode(codes), axis=1) + 1e-4
        m = min(len(ids), max(rerank, k + 1))
        out = []
        for lo in range(0, len(qids), 64):
            part, unit = q[lo : lo + 64], uq[lo : lo + 64]
            table = quantiser.value.tables(unit)
            score = np.zeros((len(part), len(ids)), np.float32)
            for s in range(codes.shape[1]):
                score += table[:, s, :][:, codes[:, s]]
            best = np.argpartition(-score, m - 1, axis=1)[:, :m]
            # k others than the query are at least as good as the k + 1st of these
            least = -np.sort(-cosine(x[best], part[:, None, :]), axis=1)[:, k] if m > k else np.full(len(part), -np.inf)
            may = score + off >= least[:, None]
            inner = unit @ ux.T if may.mean() > 0.1 else None
            for i in range(len(part)):
                rows = np.flatnonzero(may[i])
                near = ux[rows] @ unit[i] if inner is None else inner[i, rows]
                if len(rows) > k + 1:
                    rows = rows[near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1] - 1e-9]
                rows = rows[ids[rows] != qids[lo + i]]
                value = cosine(x[rows], part[i])
                order = np.lexsort((ids[rows], -value))[:k]
                out.append((np.full(len(order), qids[lo + i]), ids[rows[order]], value[order]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: no null, non-finite or only zero components, not empty."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, rerank: int = 100, parts: int = 32, eta: float = 4.0, sample_rows: int = 10_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k nearest rows of `vectors` by cosine, itself left out.

    Both have vec_id and embedding; vectors null, with null or non-finite components or without any but zeros take no part,
    nor do null vec_ids. Vectors are compared with those of their own length, each length searched by itself. Ties go to
    the smaller vec_id. Codebooks are fitted on about `sample_rows` rows; every row is coded and scanned. Each pair of a
    candidate block and a query block is one group: the `rerank` best table scores per query and block give a bound, and
    every candidate whose table score is within its error of it is scored exactly, so the result is that of a full search.
    Of rows that repeat a vec_id the smallest vector counts. Without vectors or queries the result is empty.
    """
    v, q = (usable(t).groupBy("vec_id").agg(F.min("v").alias("v")) for t in (vectors, queries))
    lengths = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).join(q.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("m")), "d").orderBy("d").collect()  # lengths that occur
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in lengths:
        found = _nearest_of_length(spark, v.where(F.size("v") == d.d), q.where(F.size("v") == d.d), d.n, d.m, k, rerank, parts, eta, sample_rows)
        out = found if d is lengths[0] else out.unionByName(found)
    return out


def _nearest_of_length(spark: SparkSession, v: DataFrame, q: DataFrame, n: int, m: int, k: int, rerank: int, parts: int, eta: float, sample_rows: int) -> DataFrame:
    modulus = max(1, n // sample_rows)
    sample = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(modulus)) == 0).select("v").toArrow().column("v").to_numpy()
    if not len(sample):
        sample = v.limit(1000).select("v").toArrow().column("v").to_numpy()
    sample = np.stack(sample)
    quantiser = spark.sparkContext.broadcast(Quantiser(sample, min(parts, sample.shape[1]), eta))
    blocks, query_blocks = -(-n // BLOCK), -(-m // QUERY_BLOCK)
    dealt = v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = q.withColumn("qblock", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = dealt.groupBy("block", "qblock").cogroup(asked.groupBy("block", "qblock")).applyInArrow(_scan_task(quantiser, k, rerank), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
