"""Dense numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.lineage import cut


def pieces(df: DataFrame, order: list[str | Column], piece: str = "piece", at: str = "at") -> DataFrame:
    """df dealt to consecutive ranges of `order`: `piece` grows with the order, `at` counts from 0 inside a piece.

    The table is written to the checkpoint folder, so that both stay what they are however often it is read.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    return ranged.withColumn(piece, F.shiftright("__id", 33).cast("long")).withColumn(at, F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def numbered(df: DataFrame, order: list[str | Column], name: str = "id", first: int = 1) -> DataFrame:
    """df with `name`: first, first + 1, ... in `order`, which must tell any two rows apart.

    Rows are dealt to ranges, numbered inside them, and moved by the sizes of the ranges before: one number a range is
    collected and sent back.
    """
    dealt = pieces(df, order, "__piece", "__at")
    sizes = dealt.groupBy("__piece").agg(F.count("*").alias("n")).orderBy("__piece").collect()  # a row for each range
    starts = [0, *accumulate(r.n for r in sizes)]
    offsets = df.sparkSession.createDataFrame([(r["__piece"], first + start) for r, start in zip(sizes, starts)], "__piece long, __start long")
    return dealt.join(F.broadcast(offsets), "__piece").withColumn(name, F.col("__at") + F.col("__start")).drop("__piece", "__at", "__start")
