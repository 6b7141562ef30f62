"""Mixing sources to target weights with nested hash thresholds, on DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch

#: Histogram bits of each refinement; HASH_BITS in all.
STEP_BITS, HASH_BITS = 20, 60


def word_count(text: str) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def document_hash(*columns: str) -> Column:
    """The first 60 bits of the MD5 of the columns, a place in [0, 2^60) that does not depend on order or machine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: list[float], most: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): sorted sources take the weights in turn, null last.

    Targets share the total by weight, at most `most` times the source's size; what is above is shared again by weight.
    Sorted by size over weight the sources at their limit come first, so the common level follows from running sums. The
    table has one row per source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    above = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(above), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    filled = weighed.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    first_free = F.max(F.when(F.col("free"), F.col("level"))).over(everything)
    return filled.select("source", "source_size", F.when(F.col("free"), first_free * F.col("w")).otherwise(F.col("cap")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: list[float] = (1, 2, 3), most: float = 3.0, size: Column | None = None) -> DataFrame:
    """`docs` with the columns size, source_size, target and repeats (how often the mix takes the row).

    A source with target T and size S takes every document floor(T / S) times, and once more those whose hash is below its
    threshold: sums by source and hash bucket give the bucket in which the budget T mod S ends, and only that bucket is
    counted again in finer buckets, until a bucket is one hash value. The document on the threshold is taken if that ends
    nearer to the budget. No sort of documents is needed, and reruns agree, as the hash is that of doc_id.

    Null texts have size 0; null sources are a source of their own; rows of one doc_id share the hash and are taken
    together; null doc_ids share one hash value in their source. Sources of size 0 have target 0 and take nothing. An empty
    table gives an empty result. Columns of these names in the input are replaced.
    """
    scratch = Scratch(spark, "mixing")
    docs = docs.drop("size", "source_size", "target", "repeats")
    size = word_count("text") if size is None else size
    sized = scratch.write(docs.select("source", document_hash("doc_id").alias("h"), size.alias("size")), "sized")
    counts = scratch.write(sized.groupBy("source", F.shiftrightunsigned("h", HASH_BITS - STEP_BITS).alias("b")).agg(F.sum("size").alias("n")), "histogram")
    plan = scratch.write(targets(counts.groupBy("source").agg(F.sum("n").alias("source_size")), list(weights), most), "targets")
    whole = F.floor(F.col("target") / F.col("source_size")).cast("long")
    budget = scratch.write(plan.where("source_size > 0").select(F.col("source").alias("s"), whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("left")), "budget")
    edge, depth = budget.select("s", "left"), STEP_BITS
    while True:
        # the first bucket that passes what is left of the budget; a source that none passes has no edge
        upto = counts.join(edge.select("s", "left"), F.col("source").eqNullSafe(F.col("s"))).withColumn("cum", F.sum("n").over(W.partitionBy("s").orderBy("b")))
        passing = upto.where("cum > left").groupBy("s").agg(F.min(F.struct("b", (F.col("left") - F.col("cum") + F.col("n")).alias("left"), "n")).alias("e"))
        edge = scratch.write(passing.select("s", "e.left", "e.b", "e.n"), "edge")
        if depth == HASH_BITS:
            break
        bucket = F.shiftrightunsigned("h", HASH_BITS - depth)
        sized = scratch.write(sized.join(edge.select("s", F.col("b")), F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("b"))).select("source", "h", "size"), "inside")
        depth = min(HASH_BITS, depth + STEP_BITS)
        counts = sized.groupBy("source", F.shiftrightunsigned("h", HASH_BITS - depth).alias("b")).agg(F.sum("size").alias("n"))
    # at full depth a bucket is one hash value: taken if at least half of it fits
    limit = edge.select(F.col("s").alias("s2"), (F.col("b") + F.when(F.col("n") <= 2 * F.col("left"), 1).otherwise(0)).alias("limit"))
    final = plan.join(budget.drop("left"), F.col("source").eqNullSafe(F.col("s")), "left").join(limit, F.col("source").eqNullSafe(F.col("s2")), "left")
    everything = F.lit(1 << HASH_BITS).cast("long")
    final = scratch.write(final.select(F.col("source").alias("__s"), "source_size", "target", F.coalesce("whole", F.lit(0)).alias("__whole"), F.when(F.col("whole").isNull(), F.lit(0)).otherwise(F.coalesce("limit", everything)).cast("long").alias("__limit")), "plan")
    scratch.close(final)
    taken = docs.withColumn("size", size).join(final, F.col("source").eqNullSafe(F.col("__s")))
    repeats = F.least(F.floor(F.lit(most)).cast("long"), F.col("__whole") + F.when(document_hash("doc_id") < F.col("__limit"), 1).otherwise(0))
    return taken.withColumn("repeats", repeats).drop("__s", "__whole", "__limit")
