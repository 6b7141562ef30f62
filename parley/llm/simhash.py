"""Document fingerprints by SimHash, and all pairs within a Hamming radius by permuted block tables.

Each distinct term (a pair of neighbouring words, or the only word) votes with its weight on the sign of every bit; the
weight grows with the logarithm of its count. Fingerprints of BITS bits are kept as binary.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml.feature import Bucketizer

from parley.llm import textkit as T
from parley.llm.scratch import Scratch
from parley.llm.voronoi import link

BITS = 256
WIDTH = BITS // 8
#: Bytes of text of a range of documents that one task edits, and the most ranges.
RANGE_BYTES, MOST_RANGES = 16 << 20, 20_000
_SEEDS = [T.U(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


#: Terms whose votes are added at once: weights are far below 2^9, so sums of a slice are exact in single precision.
_SLICE = 1 << 15


def votes(terms: np.ndarray, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Packed signs of the weighted votes of term hashes; a tie or no term gives 0. Sums of integer weights are exact."""
    total = np.zeros(bits, np.int64)
    for lo in range(0, len(terms), _SLICE):
        part = terms[lo : lo + _SLICE]
        signs = np.concatenate([T.mix(part ^ s).view(np.uint8).reshape(-1, 8) for s in _SEEDS[: bits // 64]], axis=1)
        total += (weights[lo : lo + _SLICE].astype(np.float32) @ np.unpackbits(signs, axis=1).astype(np.float32)).astype(np.int64)
    return np.packbits(2 * total > int(weights.sum()))


def fingerprint(words: np.ndarray) -> np.ndarray:
    """The fingerprint of one text's word hashes."""
    terms, counts = np.unique(T.shingles(words, 2), return_counts=True)
    return votes(terms, np.rint(16 * (1 + np.log(counts)))) if len(terms) else np.zeros(WIDTH, np.uint8)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in T.texts(pa.array(texts, pa.large_binary())):
        words, at, *_ = T.word_hashes(data, offsets)
        out += [fingerprint(words[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
    return out


def hamming(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _ONES[many ^ one].sum(axis=1, dtype=np.int32)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine that the share of differing bits stands for, 0 at least."""
    return max(0.0, float(np.cos(np.pi * int(_ONES[x ^ y].sum()) / BITS)))


def block_keys(fingerprint: str, bits: int, radius: int, blocks: int | None = None):
    """Column of table keys of a binary fingerprint: of `blocks` blocks (radius + 1 if None) each choice of blocks - radius.

    Fingerprints within the radius agree on at least blocks - radius of the blocks, so they share a key.
    """
    blocks = blocks or radius + 1
    if not radius < blocks <= bits // 8:
        raise ValueError("radius < blocks <= bits / 8")
    cut = [i * (bits // 8) // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        keys.append(F.xxhash64(F.lit(k), *[F.substring(fingerprint, cut[i] + 1, cut[i + 1] - cut[i]) for i in chosen]))
    return F.array(*keys)


def near_classes(prints: DataFrame, radius: int, scratch: Scratch, bits: int = BITS, blocks: int | None = None) -> DataFrame:
    """(doc_id, near_id) of prints (doc_id, sig): near_id is the smallest doc_id reachable by steps within the radius.

    Equal fingerprints are one class from the start; no pairs inside a class are made. Null doc_ids are left out.
    """
    prints = prints.where("doc_id is not null").select("doc_id", "sig").distinct()
    classes = scratch.write(prints.groupBy("sig").agg(F.min("doc_id").alias("id")), "classes")
    members = classes.dropDuplicates(["id"]).select("id", "sig", F.explode(F.array_distinct(block_keys("sig", bits, radius, blocks))).alias("region"))
    labels = link(members, classes.dropDuplicates(["id"]).select("id", "sig"), lambda pairs: pairs, hamming, bits // 8, radius, scratch)
    named = classes.join(labels, "id", "left").select("sig", F.coalesce("label", "id").alias("near_id"))
    return prints.join(named, "sig").groupBy("doc_id").agg(F.min("near_id").alias("near_id"))


def _cut(text: bytes, chars: int) -> int:
    """Byte position after the first `chars` code points (or all)."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return len(text) if chars >= len(starts) else int(starts[chars])


def _edit_task(batches):
    """Rows sorted by (bucket, tail, doc_id, text); a row with `tail` set only lends its text to the row before it."""
    last = None

    def finish(rows):
        edited = []
        for (_, _, text, n, _), (_, _, after, _, _) in zip(rows, rows[1:]):
            k = n // 4
            edited.append(text[: _cut(text, n - k)] + after[: _cut(after, k)])
        for (_, doc, _, n, own), (_, _, _, _, following), text, changed in zip(rows, rows[1:], edited, fingerprints(edited)):
            yield doc, n, hashlib.sha256(text).hexdigest(), own.tobytes(), changed.tobytes().hex(), likeness(own, changed), likeness(own, following)

    for batch in batches:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text").cast(pa.binary())]
        rows = [] if last is None else [last]
        out = []
        for bucket, doc, tail, text, own in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("tail").to_pylist(), texts, fingerprints(texts)):
            if rows and rows[-1][0] != bucket:
                raise AssertionError("a bucket ended without the row that follows it")
            rows.append((bucket, doc, text, len(text) - int(((np.frombuffer(text, np.uint8) & 0xC0) == 0x80).sum()), own))
            if tail:
                out += finish(rows)
                rows = []
        out += finish(rows)
        last = rows[-1] if rows else None
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_sha256", "sig", "edited_fingerprint", "near_edited", "near_next"])


def _ranges(docs: DataFrame, column: str, size: int) -> list[float]:
    """Borders that cut `docs` by a column (nulls before all) into ranges of about `size` bytes of text; equal values stay together."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(min(MOST_RANGES, max(1, total // size)))
    at = docs.agg(F.percentile_approx(column, [i / (4 * parts) for i in range(1, 4 * parts)], 10_000)).first()[0] or []
    fine = [-float("inf"), *sorted(set(at) or {0.0}), float("inf")]
    placed = Bucketizer(splits=fine, inputCol=column, outputCol="b").transform(docs.select(F.coalesce(column, F.lit(float("-inf"))).alias(column), "text"))
    bytes_of = dict(placed.groupBy(F.col("b").cast("int")).agg(F.sum(F.octet_length("text").cast("long"))).collect())  # a row per range
    borders, held = [], 0
    for b, border in enumerate(fine[1:-1]):
        held += bytes_of.get(b, 0)
        if held >= total / parts:
            borders.append(border)
            held = 0
    return [-float("inf"), *(borders or [fine[1]]), float("inf")]


def _keys_of_partitions(spark: SparkSession, parts: int) -> list[int]:
    """An integer for each partition number, which `repartition` on it sends there, so that no two ranges share a task."""
    n = 64 * parts
    while True:
        found = dict(spark.range(n).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(parts))).agg(F.min("k")).collect())
        if len(found) == parts:
            return [found[i] for i in range(parts)]
        n *= 4


def edited_neighbours(spark: SparkSession, docs: DataFrame, radius: int = 7) -> DataFrame:
    """One row per row of `docs` (doc_id, text) in the order (doc_id, text), each with its text edited by the next one's start.

    doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and near_id: the
    smallest doc_id reachable over fingerprints within `radius` bits. A null text is empty; an empty text has fingerprint
    zero. Rows with null doc_id come first in the order and have a null near_id. Ties in doc_id go by text. One row is its
    own next one; an empty table gives an empty result.

    Texts are dealt once, into ranges of doc_id; the first row of each range is dealt to the end of the range before too.
    """
    scratch = Scratch(spark, "simhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # null ids come first; cast to double keeps the order
    place = docs.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    splits = _ranges(place.withColumn("place", F.col("doc_id").cast("double")), "place", RANGE_BYTES)
    dealt = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(place).withColumn("bucket", F.col("bucket").cast("int"))
    # the first row of each range: as many rows as ranges; -inf stands for null ids
    firsts = dealt.groupBy("bucket").agg(F.min("place").alias("p")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_id long")
    before = {r.bucket: firsts[i - 1].bucket for i, r in enumerate(firsts)}  # the first range follows the last one
    heads = spark.createDataFrame([(r.bucket, r.p, before[r.bucket]) for r in firsts], "bucket int, place double, lent int")
    least = dealt.join(F.broadcast(heads), ["bucket", "place"]).groupBy("bucket", "lent").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    lent = least.select(F.col("lent").alias("bucket"), F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.lit(True).alias("tail"))
    parts = len(splits) - 1
    keys = F.array(*[F.lit(k) for k in _keys_of_partitions(spark, parts)])
    rows = dealt.select("bucket", "doc_id", "text", F.lit(False).alias("tail")).union(lent)
    sorted_rows = rows.withColumn("k", F.element_at(keys, F.col("bucket") + 1)).repartition(parts, "k").drop("k").sortWithinPartitions("bucket", "tail", "doc_id", "text")
    done = scratch.write(sorted_rows.mapInArrow(_edit_task, "doc_id long, n_chars long, edited_sha256 string, sig binary, edited_fingerprint string, near_edited double, near_next double"), "prints")
    near = scratch.write(near_classes(done.select("doc_id", "sig"), radius, scratch), "near")
    scratch.close(done, near)
    return done.join(near, "doc_id", "left").select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("sig")).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "near_id")
