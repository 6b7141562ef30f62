"""Rules over the rows of a conversation in order, for conversations of any length.

Rows are dealt to consecutive pieces, so one long conversation is many tasks. A rule is worked out inside each piece; what a
piece must know of those before it is a row for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators import numbering

PIECE, AT = "__piece", "__at"


def dealt(df: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """df with the piece and the place in it of each row, by conversation and order; see numbering.pieces."""
    return numbering.pieces(df, [conv, *order], PIECE, AT)


def last_known(rows: DataFrame, conv: str, values: dict[str, Column], current: bool) -> DataFrame:
    """Dealt rows with columns of the last value that is not null in their conversation, up to the row or before it.

    Values may be structs: a struct is not null even if its fields are.
    """
    rows = rows.withColumns({f"__v_{name}": value for name, value in values.items()})
    inside = W.partitionBy(conv, PIECE).orderBy(AT).rowsBetween(W.unboundedPreceding, 0 if current else -1)
    pieces = rows.groupBy(conv, PIECE).agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(AT))).alias(f"__p_{n}") for n in values])
    before = W.partitionBy(conv).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)  # a row for each piece of the conversation
    carried = pieces.select(F.col(conv).alias("__conv_of"), F.col(PIECE).alias("__piece_of"), *[F.last(f"__p_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values])
    out = rows.withColumns({n: F.last(f"__v_{n}", ignorenulls=True).over(inside) for n in values})
    out = out.join(carried, out[conv].eqNullSafe(F.col("__conv_of")) & (F.col(PIECE) == F.col("__piece_of")), "left")
    out = out.withColumns({n: F.coalesce(F.col(n), F.col(f"__c_{n}")) for n in values})
    return out.drop("__conv_of", "__piece_of", *[f"__{x}_{n}" for n in values for x in "vc"])


def run_lengths(rows: DataFrame, conv: str, marked: str, most: int, splits: Callable[[np.ndarray, bool], np.ndarray]) -> DataFrame:
    """(piece, at, segment): segments, from 0, of dealt rows whose ends depend on their length so far.

    `splits(lengths, mark)` says for lengths 1 to `most` whether a row with the mark starts a new segment after them. A
    piece is summed up as a function from the length at its entry to the length and the number of segments at its end, for
    all entries at once; these functions, a row for each piece, are applied one after the other, and then each piece is
    read with its entry known.
    """
    numbers = rows.select(PIECE, AT, F.col(conv).cast("string").alias("c"), F.coalesce(F.col(marked), F.lit(False)).alias("m"))
    lengths = np.arange(most + 1)
    table = {m: (lengths > 0) & splits(lengths, m) for m in (False, True)}

    def walk(marks: np.ndarray, length: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for m in marks:
            new = table[bool(m)][length]
            segment = segment + new
            length = np.where(new, 1, length + 1)
        return length, segment

    def edges(c: np.ndarray) -> np.ndarray:
        """Starts of the conversations of a piece, and its end."""
        null = pd.isna(c)
        change = (c[1:] != c[:-1]) & ~(null[1:] & null[:-1])
        return np.r_[0, np.flatnonzero(change) + 1, len(c)]

    def summed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(AT)
        c, m = g.c.to_numpy(), g.m.to_numpy()
        cut = edges(c)
        first = walk(m[: cut[1]], lengths.copy(), np.zeros(most + 1, np.int64))
        last = walk(m[cut[-2] :], np.zeros(1, np.int64), np.zeros(1, np.int64))
        return pd.DataFrame({PIECE: [g[PIECE].iloc[0]], "first": [c[0]], "last": [c[-1]], "one": [len(cut) == 2], "ends": [first[0].tolist()], "more": [first[1].tolist()], "end": [int(last[0][0])], "segments": [int(last[1][0])]})

    parts = numbers.groupBy(PIECE).applyInPandas(summed, f"{PIECE} long, first string, last string, one boolean, ends array<long>, more array<long>, end long, segments long")
    entries, conversation, state = [], None, (0, 0)
    for p in parts.orderBy(PIECE).collect():  # a row for each piece
        entry = state if entries and p["first"] == conversation else (0, 0)
        entries.append((p[PIECE], *entry))
        state = (p.ends[entry[0]], entry[1] + p.more[entry[0]]) if p.one else (p.end, p.segments)
        conversation = p["last"]
    known = rows.sparkSession.createDataFrame(entries, f"{PIECE} long, length long, segment long")

    def read(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(AT)
        cut, m = edges(g.c.to_numpy()), g.m.to_numpy()
        out = np.zeros(len(g), np.int64)
        for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
            length, segment = (int(g.length.iloc[0]), int(g.segment.iloc[0])) if k == 0 else (0, 0)
            for i in range(lo, hi):
                if table[bool(m[i])][length]:
                    length, segment = 1, segment + 1
                else:
                    length += 1
                out[i] = segment
        return pd.DataFrame({PIECE: g[PIECE], AT: g[AT], "segment": out})

    return numbers.join(F.broadcast(known), PIECE).groupBy(PIECE).applyInPandas(read, f"{PIECE} long, {AT} long, segment long")
