"""Keyed reads, upserts, enrichment joins, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the largest seq of each key; null and empty keys are dropped. One aggregation, no window."""
    rows = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), seq).alias("r")).select(key, "r.*").select(df.columns)


def upsert(target: DataFrame, updates: DataFrame, key: str, merge: dict[str, Column] | None = None) -> DataFrame:
    """Target rows with the columns of the update of the same key, where these are not null; `updated` tells which.

    merge gives other expressions for columns, over t.<column> and u.<column>. Keys of updates must be unique.
    """
    shared = [c for c in updates.columns if c != key and c in target.columns]
    t, u = target.alias("t"), updates.withColumn("__hit", F.lit(True)).alias("u")
    value = {c: F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")) for c in shared} | (merge or {})
    return t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "left").select(*[value[c].alias(c) if c in value else F.col(f"t.{c}") for c in target.columns], F.coalesce("u.__hit", F.lit(False)).alias("updated"))


def enrich(base: DataFrame, key: str, sides: dict[str, DataFrame]) -> DataFrame:
    """Left joins of several sides on one key; each side's columns get its name as prefix, has_<name> tells of a match."""
    for name, side in sides.items():
        side = side.select(F.col(key).alias("__k"), *[F.col(c).alias(f"{name}_{c}") for c in side.columns if c != key], F.lit(True).alias(f"has_{name}"))
        base = base.join(side, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return base


def outer_with_primary(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer join; each column from the first side where that has the row, else from the second; `source` names it."""
    a, b = first.withColumn("__a", F.lit(True)).alias("a"), second.withColumn("__b", F.lit(True)).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    source = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "first").otherwise("second")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.when(F.col("__a"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns], source.alias("source"))


def second_chance(base: DataFrame, side: DataFrame, key: str, fallback: str, value: str) -> DataFrame:
    """Left join on `key`; rows without a match take the value of the smallest key with the same `fallback`; is_reused tells."""
    own = side.select(F.col(key).alias("__k"), F.col(value).alias("__own"))
    other = side.where(F.col(value).isNotNull()).groupBy(F.col(fallback).alias("__f")).agg(F.min_by(value, key).alias("__other"))
    both = base.join(own, F.col(key) == F.col("__k"), "left").join(other, F.col(fallback) == F.col("__f"), "left")
    return both.select(*[F.col(c) for c in base.columns], F.coalesce("__own", "__other").alias(value), (F.col("__own").isNull() & F.col("__other").isNotNull()).alias("is_reused"))


def resume(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are not done yet."""
    return work.join(done.select(key), key, "left_anti")


def gate(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return rows.join(allowed.select(key), key, "left_semi")


def in_given_order(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of the given ids with their place in the list."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], ["__id", "position"])
    return rows.join(wanted, F.col(key) == F.col("__id")).drop("__id")


def band(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, width: int) -> DataFrame:
    """Pairs with equal `on` and |left.a - right.b| <= width, by equi-join on buckets of the width.

    A right row is dealt to its bucket and both neighbours, so the pairs of a bucket are found without comparing all.
    """
    step = max(1, width)
    l = left.withColumn("__bucket", F.floor(F.col(a) / step))  # noqa: E741
    r = right.withColumn("__bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(b) / step) + d)))
    return l.join(r, [*on, "__bucket"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("__bucket")


def associations(chunks: DataFrame, most: int) -> DataFrame:
    """(chunk_id, other_id, rule): related chunks by referred day, by near day of another type, by shared cause; rules in that order.

    chunks: chunk_id, day, refers array of days, type, cause. Of each chunk the first `most` others stay.
    """
    base = chunks.select("chunk_id", "day", "refers", "type", F.left("cause", F.lit(20)).alias("cause"))
    other = base.select(F.col("chunk_id").alias("other_id"), F.col("day").alias("other_day"), F.col("type").alias("other_type"), F.col("cause").alias("other_cause"))
    referred = base.select("chunk_id", F.explode("refers").alias("other_day")).join(other, "other_day").select("chunk_id", "other_id", F.lit(1).alias("rule"))
    near = band(base, other, [], "day", "other_day", 2).where("day <> other_day and type <> other_type").select("chunk_id", "other_id", F.lit(2).alias("rule"))
    cause = base.where("cause <> ''").join(other, F.col("cause") == F.col("other_cause")).select("chunk_id", "other_id", F.lit(3).alias("rule"))
    every = referred.union(near).union(cause).where("chunk_id <> other_id").groupBy("chunk_id", "other_id").agg(F.min("rule").alias("rule"))
    rank = F.row_number().over(W.partitionBy("chunk_id").orderBy("rule", "other_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def prefer_complete(results: DataFrame, key: str, complete: str, order: list[str]) -> DataFrame:
    """One row per key: the first in order, unless only a later one is complete."""
    w = W.partitionBy(key).orderBy(F.col(complete).desc(), *order)
    return results.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows and the incoming ones with a new key."""
    return existing.unionByName(resume(incoming, existing, key), allowMissingColumns=True)


def merge_lists(a: str, b: str, most: int) -> Column:
    """Distinct trimmed strings of two arrays in order, blank ones left out, at most `most`."""
    both = F.transform(F.concat(F.coalesce(F.col(a), F.array().cast("array<string>")), F.coalesce(F.col(b), F.array().cast("array<string>"))), lambda s: F.trim(s))
    return F.slice(F.array_distinct(F.filter(both, lambda x: x != "")), 1, most)


def resolve_spans(spans: str) -> Column:
    """Of overlapping spans (start, end, confidence, ...) the longer stays, of equal ones the more certain; array of structs.

    Spans are taken by start, longest first, and compared with the last one kept.
    """
    ordered = F.array_sort(F.col(spans), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(F.sign(b["confidence"] - a["confidence"]).cast("int")))

    def step(kept, span):
        last = F.element_at(kept, -1)
        longer = (span["end"] - span["start"]) > (last["end"] - last["start"])
        return (
            F.when(F.size(kept) == 0, F.array(span))
            .when(span["start"] >= last["end"], F.concat(kept, F.array(span)))
            .when(longer, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(span)))
            .otherwise(kept)
        )

    return F.aggregate(ordered, F.filter(F.col(spans), lambda s: F.lit(False)), step)


def dedupe_by_prefix(items: str, chars: int, most: int) -> Column:
    """Array items of which no earlier one has the same first characters, at most `most`."""
    head = lambda x: F.left(x, F.lit(chars))
    return F.aggregate(F.col(items), F.array().cast("array<string>"), lambda kept, x: F.when((F.size(kept) < most) & ~F.exists(kept, lambda y: head(y) == head(x)), F.concat(kept, F.array(x))).otherwise(kept))
