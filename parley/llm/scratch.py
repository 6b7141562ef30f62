"""Intermediate tables in the folder that all executors share, and the small helpers around them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of the filter of wanted ids: 2^23 bits are at most 131,072 rows of two longs (2 MB), however many ids are wanted.
FILTER_BITS = 1 << 23
#: Set while a table is written.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset (local tests) a folder of this machine."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = f"file://{tempfile.gettempdir()}/parley-scratch"
    return have.rstrip("/")


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session while the block runs."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one run, written as Parquet under the shared folder; a lost executor only repeats its own tasks.

    A table is dropped once no later step reads it; `close` drops all but those that a result still reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.tables: list[tuple[DataFrame, str]] = []
        _open.append(self)

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """`df` written and read again; rows: so many go to a Python task at once, for tables with whole texts.

        The shuffle files of a write are deleted at its end, not when the driver happens to collect its garbage.
        """
        self.n += 1
        path = f"{self.folder}/{self.n}-{name}"
        with _set(self.spark, CLEANUP | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that no later step reads; other frames are passed over."""
        for df, path in self.tables:
            if any(df is t for t in tables):
                self._delete(path)
        self.tables = [(df, path) for df, path in self.tables if not any(df is t for t in tables)]

    def close(self, *keep: DataFrame) -> None:
        """Delete every table but those in `keep`."""
        self.drop(*[df for df, _ in self.tables if not any(df is k for k in keep)])
        if not self.tables:
            self._delete(self.folder)


#: Runs whose results may still read their tables.
_open: list[Scratch] = []


@contextlib.contextmanager
def released() -> Iterator[None]:
    """What is written by the operators called inside goes when the block ends: write their results before."""
    before = len(_open)
    yield
    for scratch in _open[before:]:
        scratch.close()
    del _open[before:]


def _marked(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """`df` with the word of the bitmap of the ids at the cell of its key, `__bits`, and the cell, `__c`."""
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))
    bits = ids.select(cell.alias("c")).groupBy(F.shiftright("c", 6).alias("__cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c & 63 as int))")).alias("__bits"))
    return df.withColumn("__c", cell).withColumn("__cell", F.shiftright("__c", 6)).join(F.broadcast(bits), "__cell", how)


_HIT = "(shiftright(__bits, cast(__c & 63 as int)) & 1) = 1"


def likely(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key is in the one-column table `ids` (of the same name), and few others.

    A bitmap of the ids, at most FILTER_BITS large whatever their number, is broadcast, so that few of the other rows are
    shuffled by a join that follows and decides exactly.
    """
    return _marked(df, ids, key, "inner").where(F.expr(_HIT)).select(df.columns)


def others(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of `df` that are not in `likely`."""
    return _marked(df, ids, key, "left").where(F.expr(f"not coalesce({_HIT}, false)")).select(df.columns)


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key is in the one-column table `ids` (distinct values of the same name).

    After `likely` the join with the ids decides exactly. It is no semi join, which the optimiser would move below the bitmap.
    """
    return likely(df, ids, key).join(ids.select(key).distinct(), key).select(df.columns)
