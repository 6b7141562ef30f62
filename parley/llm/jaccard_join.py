"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least t, as components.

Jaccard distance is a metric. Whole documents as first pivots fail here: nearly all documents are at distance close to 1
from any document, so nearly every one would lie in every window of width 2(1-t) and be copied to every region. The first
pivots are therefore shingles: in a global order of shingles, a document's distance to a shingle it holds is the share of
its set before that shingle; its home region is its first shingle, and the triangle inequality copies it to the regions
of its first (1-t) share, since a partner lacks at most that share. Any two linking documents meet in the region of their
first common shingle. Inside a region documents are the pivots, with recursion as in `voronoi`, on a signature whose
distance bounds the Jaccard distance from below; every link is verified on the full sets.
The order puts shingles seen in two or more documents of a bounded sample last, which affects cost only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import textkit as T
from parley.llm.components import components
from parley.llm.scratch import Scratch, only
from parley.llm.voronoi import link

#: Slices of the hash space; a signature holds the parity of a set's size in each, after the size itself.
SLICES = 2048
WIDTH = 8 + SLICES // 8
#: Bits of the table of frequent shingles; a cell is set if one of its shingles is in two sample documents.
COMMON_BITS = 23
#: A class of equal sets that holds more than one row in so many is joined by broadcast: at most so many rows.
HEAVY = 10_000


def lower(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bound on Jaccard distance from set sizes and the parities of their slices.

    Each slice of unequal parity holds an element that is in one set only; with D the larger of the number of such slices
    and the difference of sizes, the distance is at least 2D / (|x| + |y| + D): Steinhaus' transform of a metric, a metric.
    """
    x, y = np.ascontiguousarray(many).view("<u8"), np.ascontiguousarray(one).view("<u8")
    nx, ny = x[:, 0].astype(np.int64), y[:, 0].astype(np.int64)
    apart = np.maximum(np.bitwise_count(x[:, 1:] ^ y[:, 1:]).sum(axis=1, dtype=np.int64), np.abs(nx - ny))
    return 2 * apart / np.maximum(nx + ny + apart, 1) - 1e-12


def signature(found: np.ndarray) -> np.ndarray:
    """Size and packed slice parities of a set of hashes."""
    odd = np.bincount((found & T.U(SLICES - 1)).astype(np.int64), minlength=SLICES) & 1
    return np.concatenate([np.array([len(found)], "<u8").view(np.uint8), np.packbits(odd.astype(np.uint8))])


def shingle_sets(column: pa.Array, n: int):
    """The sorted distinct shingle hashes of each text of a column."""
    for _, _, data, offsets in T.texts(column):
        words, at, *_ = T.word_hashes(data, offsets)
        for lo, hi in zip(at[:-1], at[1:]):
            yield np.unique(T.shingles(words[lo:hi], n))


def _sample_task(n: int):
    def run(batches):
        for batch in batches:
            for found in shingle_sets(batch.column(0), n):
                yield pa.RecordBatch.from_arrays([T.longs(found)], names=["h"])

    return run


def common_table(docs: DataFrame, n: int, sample_docs: int) -> np.ndarray:
    """Packed bits over the top COMMON_BITS of shingle hashes (1 MB): set where two or more of `sample_docs` documents have one."""
    total = docs.count()
    modulus = max(1, total // sample_docs)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(modulus)) == 0).select("text")
    cells = sample.mapInArrow(_sample_task(n), "h long").groupBy("h").count().where("count > 1").select(F.shiftrightunsigned("h", 64 - COMMON_BITS).cast("int").alias("c")).distinct()
    bits = np.zeros(1 << COMMON_BITS, dtype=bool)
    words = cells.groupBy(F.shiftright("c", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, c & 31)")).alias("b")).toArrow()  # 2^18 rows at most
    at, mask = words.column("w").to_numpy(), words.column("b").to_numpy()
    for j in range(32):
        bits[at[(mask >> j) & 1 == 1] * 32 + j] = True
    return np.packbits(bits)


def _feature_task(n: int, percent: int, common):
    def run(batches):
        table = np.unpackbits(common.value).view(bool)
        for batch in batches:
            ids, sets = batch.column("doc_id"), []
            sizes, keys1, keys2 = [], [], []
            sketch = np.zeros((batch.num_rows, WIDTH), dtype=np.uint8)
            for i, found in enumerate(shingle_sets(batch.column("text"), n)):
                size = len(found)
                sizes.append(size)
                keys1.append(T.mix(found ^ T.U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                keys2.append(T.mix(found ^ T.U(0x14057B7EF767814F)).sum(dtype=np.uint64))
                sketch[i] = signature(found)
                late = table[(found >> T.U(64 - COMMON_BITS)).astype(np.int64)]
                need = (percent * size + 99) // 100
                sets.append(np.concatenate([found[~late], found[late]])[: size - need + 1] if size else found)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), T.longs(np.array(keys1, np.uint64)), T.longs(np.array(keys2, np.uint64)), T.binary(sketch), T.long_lists(sets)],
                names=["doc_id", "size", "k1", "k2", "sig", "anchors"],
            )

    return run


def _verify_task(n: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            for x, y in zip(shingle_sets(batch.column("ta"), n), shingle_sets(batch.column("tb"), n)):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verify(docs: DataFrame, place: DataFrame, n: int, percent: int):
    """Pairs (a, b) of class ids to those whose full shingle sets are similar enough; place: (id, doc_id, k1, k2, size)."""

    def run(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = only(place, ids, "id")
        have = only(docs.select("doc_id", "text"), wanted.select("doc_id").distinct(), "doc_id")
        texts = have.join(wanted.select("id", "doc_id"), "doc_id").select("id", "text")
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return both.mapInArrow(_verify_task(n, percent), "a long, b long").distinct()

    return run


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, sample_docs: int = 10_000) -> DataFrame:
    """One row per row of `docs` (needs doc_id, text): doc_id, n_shingles, class_id, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct n-word shingles; with fewer words
    the whole sequence is the one shingle. class_id is the smallest doc_id with the same set, component_id the smallest
    reachable by links. Null, empty and blank texts have no shingles and link with nothing, so both are their own doc_id.
    Null doc_ids give null for both and link with nothing. A repeated doc_id counts as one document with the links of all
    its rows, and returns a row each. Further columns of `docs` are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = spark.sparkContext.broadcast(common_table(docs, n, sample_docs))
    features = scratch.write(docs.mapInArrow(_feature_task(n, percent, common), "doc_id long, size long, k1 long, k2 long, sig binary, anchors array<long>"), "features", 1000)
    key = ["k1", "k2", "size"]
    full = features.where("size > 0 and doc_id is not null")
    classes = scratch.write(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    rows = max(1, features.count())
    # a class of one row needs no join, a heavy one no shuffle
    heavy = classes.where(F.col("rows") * HEAVY > rows)
    named = full.select("doc_id", *key).join(F.broadcast(heavy.select(*key, F.col("rep").alias("of"))), key, "left")
    others = named.where("of is null").drop("of").join(classes.where((F.col("rows") * HEAVY <= rows) & (F.col("rows") > 1)).select(*key, "rep"), key, "left")
    member = scratch.write(named.where("of is not null").select("doc_id", F.col("of").alias("rep"), *key).union(others.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), *key)).distinct(), "members")
    # sets are told apart by their class, as a document may have several rows with different sets
    own = F.xxhash64(*key)
    reps = features.join(member.where("doc_id = rep").select("doc_id", *key), ["doc_id", *key], "left_semi").withColumn("id", own)
    regions = reps.select("id", F.explode("anchors").alias("region"))
    signatures = reps.select("id", "sig").dropDuplicates(["id"])
    place = member.where("doc_id = rep").select(own.alias("id"), "doc_id", *key)
    labels = link(regions, signatures, verify(docs, place, n, percent), lower, WIDTH, 1 - percent / 100, scratch)
    # a document with rows in several classes ties those classes together
    joined = member.select("doc_id", "rep", own.alias("id")).join(labels, "id", "left").select("doc_id", "rep", "id", F.coalesce("label", "id").alias("label"))
    tied = scratch.write(joined.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.min("label").alias("label"), F.max("label").alias("last")), "tied")
    ties = tied.where("label <> last")
    if not ties.isEmpty():
        edges = joined.join(ties.select("doc_id", F.col("label").alias("to")), "doc_id").select(F.col("label").alias("a"), F.col("to").alias("b")).distinct()
        again = components(edges, scratch)
        tied = tied.join(again.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("doc_id", "rep", F.coalesce("to", "label").alias("label"))
    # labels are class hashes; the smallest document of each names the component
    smallest = tied.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("docs"))
    smallest = smallest.where("docs > 1").select("label", "component_id")
    final = scratch.write(tied.join(smallest, "label", "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id")), "final")
    sizes = scratch.write(features.select("doc_id", F.col("size").alias("n_shingles")), "sizes")
    scratch.close(final, sizes)
    return sizes.join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component (all with null doc_id or without words); columns unchanged.

    Of repeated rows with one doc_id all stay: they are one document.
    """
    keep = jaccard_components(spark, docs, n, percent).where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi")
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)
