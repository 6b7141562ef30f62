"""Names in texts by one dictionary: candidates, a table of confirmed names kept in versions, and their replacement.

A dictionary that fits in a bound is an automaton that every task reads once a text, whatever the number of names; a larger
one is joined with the pieces of the texts that are as long as some name. Both find the same hits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from parley.operators import numbering, privacy

HITS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("name", StringType()), StructField("code", StringType())]))
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("code", pa.string())]))
Hit = tuple[int, int, str, str | None]
#: Characters of names of which an automaton is built and broadcast (some 50 bytes each).
MOST_CHARS = 4_000_000
#: Bytes and rows of texts whose hits a task holds at once.
PIECE, PIECE_ROWS = 1 << 20, 1000
REAL, UNCERTAIN = "real_name", "uncertain"


# The table of confirmed names: text, category, frequency, alias, contexts.


def confirm(candidates: DataFrame, verdicts: DataFrame, contexts: int = 3) -> DataFrame:
    """Confirmed and uncertain names from candidates (key, candidate, context) and verdicts (candidate, category).

    Names are counted over all texts and keep their first contexts in order of the key; other categories are left out.
    """
    judged = verdicts.where(F.col("category").isin(REAL, UNCERTAIN)).groupBy("candidate").agg(F.min("category").alias("category"))
    key = next(c for c in candidates.columns if c not in ("candidate", "context"))
    rank = F.row_number().over(W.partitionBy("candidate").orderBy(key, "context"))
    first = candidates.withColumn("r", rank).where(F.col("r") <= contexts).groupBy("candidate").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "context"))), lambda x: x["context"]).alias("contexts"))
    counted = candidates.groupBy("candidate").agg(F.count("*").alias("frequency"))
    return counted.join(judged, "candidate").join(first, "candidate").select(F.col("candidate").alias("text"), "category", "frequency", F.lit(None).cast("string").alias("alias"), "contexts")


def phase1(texts: DataFrame, key: str, text: str, surnames: list[str], classify: Callable[[DataFrame], DataFrame], exclude: list[str] = ()) -> DataFrame:
    """Candidates of the texts, judged once each by the caller's `classify` ((candidate) to (candidate, category)), as confirmed names."""
    found = privacy.name_candidates(texts, key, text, surnames, list(exclude))
    return confirm(found, classify(found.select("candidate").distinct()))


def add_names(names: DataFrame, more: DataFrame) -> DataFrame:
    """`names` with rows of `more`; of an equal text the row of `more` counts."""
    return names.join(more.select("text"), "text", "left_anti").unionByName(more, allowMissingColumns=True)


def remove_names(names: DataFrame, texts: DataFrame) -> DataFrame:
    """`names` without the texts of the table `texts` (text)."""
    return names.join(texts.select("text"), "text", "left_anti")


def alias_map(names: DataFrame) -> DataFrame:
    """(text, alias) of the names that have an alias."""
    return names.where("alias is not null and alias <> ''").select("text", "alias")


def save_names(names: DataFrame, path: str, version: int) -> None:
    """Write a version of the table; versions already there stay, so readers of them are not disturbed."""
    names.write.parquet(f"{path}/version={version}")


def load_names(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given or the latest version of the table; the version is a folder, so others are not read."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == last).drop("version")


def codes(names: DataFrame, me: list[str] = (), other: list[str] = ()) -> DataFrame:
    """(text, code) of the real names: its alias, ME or OTHER, else PERSON_n in order of the text."""
    real = names.where((F.col("category") == REAL) & (F.coalesce("text", F.lit("")) != "")).groupBy("text").agg(F.min("alias").alias("alias"))
    role = F.coalesce(F.nullif("alias", F.lit("")), F.when(F.col("text").isin(list(me)), "ME"), F.when(F.col("text").isin(list(other)), "OTHER"))
    given = real.select("text", role.alias("code"))
    rest = numbering.numbered(given.where("code is null").select("text"), ["text"], "n")
    return given.where("code is not null").unionByName(rest.select("text", F.concat(F.lit("PERSON_"), "n").alias("code")))


# Hits.


def _word(c: str) -> bool:
    return (c.isalnum() or c == "_") and not "一" <= c <= "鿿"


def _lower(s: str) -> str:
    low = s.lower()
    return low if len(low) == len(s) else "".join(x if len(x := c.lower()) == 1 else c for c in s)


def _bounded(text: str, start: int, end: int) -> bool:
    return not (start and _word(text[start - 1]) and _word(text[start])) and not (end < len(text) and _word(text[end - 1]) and _word(text[end]))


def longest_first(hits: list[Hit]) -> list[Hit]:
    """Hits taken longest first, then by start, of which none overlaps one taken before; by start."""
    starts: list[int] = []
    taken: list[Hit] = []
    for hit in sorted(set(hits), key=lambda h: (h[0] - h[1], h[0], h[2])):
        i = bisect_left(starts, hit[0])
        if (i == 0 or taken[i - 1][1] <= hit[0]) and (i == len(taken) or hit[1] <= taken[i][0]):
            starts.insert(i, hit[0])
            taken.insert(i, hit)
    return taken


class Dictionary:
    """Names with their codes, and the phrases that excuse a name inside them, in one automaton."""

    def __init__(self, names: list[tuple[str, str | None]], exclude: list[str] = (), around: int = 5, borders: bool = False, ignore_case: bool = False):
        self.fold = _lower if ignore_case else str
        self.around, self.borders = around, borders
        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, tuple[tuple[str, str | None] | None, bool]] = {}
        for name in names:
            kinds.setdefault(self.fold(name[0]), (name, False))
        for phrase in exclude:
            kinds[self.fold(phrase)] = (kinds.get(self.fold(phrase), (None, False))[0], True)
        for word, (name, excuse) in kinds.items():
            if word:
                self.automaton.add_word(word, (len(word), word if excuse else None, name))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str | None, more: list[Hit] = ()) -> list[Hit]:
        """Hits of a text, and of `more` that were found elsewhere, those that count, by start."""
        found, excuses = list(more), []
        if text and len(self.automaton):
            for last, (size, phrase, name) in self.automaton.iter(self.fold(text)):
                if phrase is not None:
                    excuses.append((last + 1 - size, last + 1, phrase))
                if name is not None:
                    found.append((last + 1 - size, last + 1, *name))
        if self.borders:
            found = [h for h in found if _bounded(text, h[0], h[1])]
        if excuses:
            excuses.sort()
            found = [h for h in found if not self._excused(h, excuses)]
        return longest_first(found)

    def _excused(self, hit: Hit, excuses: list[tuple[int, int, str]]) -> bool:
        start, end, folded = hit[0] - self.around, hit[1] + self.around, self.fold(hit[2])
        for a, b, phrase in excuses[bisect_left(excuses, (start,)) :]:
            if a >= end:
                return False
            if b <= end and folded in phrase:
                return True
        return False


def _by_piece(df: DataFrame, text: str, schema: StructType, columns: Callable[[dict[str, pa.Array]], dict[str, pa.Array]]) -> DataFrame:
    """df with the new or changed `columns` worked out for some PIECE bytes of texts at a time, as hits take many times the
    room of their texts; rows come in schema's order of columns."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sofar = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(sofar, (sofar[lo - 1] if lo else 0) + PIECE, "right"))
                hi = min(max(hi, lo + 1), lo + PIECE_ROWS)
                part = batch.slice(lo, hi - lo)
                have = dict(zip(part.schema.names, part.columns))
                have |= columns(have)
                yield pa.RecordBatch.from_arrays([have[c] for c in names], names=names)
                lo = hi

    return df.mapInArrow(run, schema)


def _rows(hits: list[Hit]) -> list[dict]:
    return [dict(zip(("start", "end", "name", "code"), h)) for h in hits]


def name_hits(df: DataFrame, key: str, text: str, names: DataFrame, out: str = "hits", exclude: list[str] = (), around: int = 5, borders: bool = False, ignore_case: bool = False) -> DataFrame:
    """df with `out`, the array of (start, end, name, code) of the names in its texts, in code points, by start.

    `names` has text and code; of rows with one text the smallest code counts. Of overlapping hits the longest counts, then
    the first. A hit is excused if a phrase of `exclude` that holds the name lies within `around` characters on either side
    of it. With `borders` a hit must not continue a word that is not written in Han characters. With `ignore_case` names
    that differ in case only are one. Null texts have no hits; null and empty names are passed over.

    Names of up to MOST_CHARS characters are collected and broadcast as an automaton. A larger table is joined with the
    pieces of the texts; only there `key` must tell the rows apart.
    """
    words = names.where("text is not null and text <> ''").groupBy("text").agg(F.min("code").alias("code"))
    if (words.agg(F.sum(F.length("text"))).first()[0] or 0) > MOST_CHARS:
        return _hits_by_join(df, key, text, words, out, list(exclude), around, borders, ignore_case)
    shared = df.sparkSession.sparkContext.broadcast(Dictionary(sorted((r.text, r.code) for r in words.collect()), list(exclude), around, borders, ignore_case))

    df = df.drop(out)

    def find(have: dict[str, pa.Array]) -> dict[str, pa.Array]:
        return {out: pa.array([_rows(shared.value.hits(t)) for t in have[text].to_pylist()], _HITS)}

    return _by_piece(df, text, StructType([*df.schema, StructField(out, HITS)]), find)


def _hits_by_join(df: DataFrame, key: str, text: str, words: DataFrame, out: str, exclude: list[str], around: int, borders: bool, ignore_case: bool) -> DataFrame:
    """The same hits by a join of the names with all pieces of the texts that are as long as a name."""
    fold = F.lower if ignore_case else (lambda c: c)
    sized = words.select(fold(F.col("text")).alias("__piece"), F.length("text").alias("__size"), F.struct("text", "code").alias("n")).groupBy("__piece", "__size").agg(F.min("n").alias("__n"))
    sizes = [r[0] for r in sized.select("__size").distinct().orderBy("__size").collect()]  # lengths that occur
    places = df.where(F.length(text) > 0).select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.explode(F.sequence(F.lit(1), F.length(text))).alias("__at"))
    cut = places.select("__key", "__text", "__at", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("__size")).where(F.col("__at") + F.col("__size") - 1 <= F.length("__text"))
    pieces = cut.select("__key", "__at", "__size", fold(F.substring(F.col("__text"), F.col("__at"), F.col("__size"))).alias("__piece"))
    hit = F.struct((F.col("__at") - 1).alias("start"), (F.col("__at") + F.col("__size") - 1).alias("end"), F.col("__n.text").alias("name"), F.col("__n.code").alias("code"))
    found = pieces.join(sized, ["__piece", "__size"]).groupBy("__key").agg(F.collect_list(hit).alias("__hits"))  # of one text
    shared = df.sparkSession.sparkContext.broadcast(Dictionary([], exclude, around, borders, ignore_case))

    df = df.drop(out)

    def resolve(have: dict[str, pa.Array]) -> dict[str, pa.Array]:
        found = [[(h["start"], h["end"], h["name"], h["code"]) for h in hs or []] for hs in have["__hits"].to_pylist()]
        return {out: pa.array([_rows(shared.value.hits(t, hs)) if hs else [] for t, hs in zip(have[text].to_pylist(), found)], _HITS)}

    return _by_piece(df.join(found, df[key] == F.col("__key"), "left").drop("__key"), text, StructType([*df.schema, StructField(out, HITS)]), resolve)


def _put(text: str | None, hits: list[dict] | None) -> str | None:
    """The text with every hit replaced by its code in brackets; places are those of the text given."""
    parts, at = [], 0
    for h in hits or []:
        parts += [text[at : h["start"]], f"[{h['code']}]"]
        at = h["end"]
    return "".join(parts) + text[at:] if parts else text


def replace_names(df: DataFrame, key: str, text: str, coded: DataFrame, **options) -> DataFrame:
    """Phase two: df with the names of its texts replaced by [code], and `replaced`, their number; options of `name_hits`."""
    found = name_hits(df, key, text, coded, "__hits", **options)
    found = found.drop("replaced")
    fields = [StructField(text, StringType()) if f.name == text else f for f in found.schema if f.name != "__hits"]

    def put(have: dict[str, pa.Array]) -> dict[str, pa.Array]:
        lists = have["__hits"].to_pylist()
        return {text: pa.array(map(_put, have[text].to_pylist(), lists), pa.string()), "replaced": pa.array([len(hs) for hs in lists], pa.int32())}

    return _by_piece(found, text, StructType([*fields, StructField("replaced", IntegerType())]), put)
