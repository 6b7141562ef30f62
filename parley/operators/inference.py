"""The deterministic shell around models: batches, resume, output parsing, verdicts, maxima over frames.

A model is a function from a list of texts to a list of texts that the caller passes; none is included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import json_block


def _outputs(model: Callable[[list[str]], list[str]], texts: list[str], retries: int) -> list[tuple[str | None, str | None]]:
    """(output, error) of each text: a failing batch is tried again, then in halves, so that only the texts that fail have an error."""
    for attempt in range(retries + 1):
        try:
            return [(o, None) for o in model(texts)]
        except Exception as e:  # a model's own failure belongs to the row
            error = f"{type(e).__name__}: {e}"
    if len(texts) == 1:
        return [(None, error)]
    half = len(texts) // 2
    return _outputs(model, texts[:half], retries) + _outputs(model, texts[half:], retries)


def apply_model(df: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 50, retries: int = 0) -> DataFrame:
    """(key, output, error): `make` runs once per task and gives the model; a text that fails gives its error, not the job's end.

    A batch that fails is tried `retries` times more and then halved.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                out = _outputs(model, part[text].fillna("").tolist(), retries)
                yield pd.DataFrame({key: part[key].to_numpy(), "output": [o for o, _ in out], "error": [e for _, e in out]})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, output string, error string")


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a good result so far."""
    return df.join(done.where("error is null").select(key), key, "left_anti")


def parse(output: str, schema: str) -> Column:
    """The JSON of an output by schema; null if there is none or it does not fit."""
    return F.from_json(json_block(output), schema)


def checked(df: DataFrame, parsed: str, enums: dict[str, list[str]], lists: dict[str, tuple[int, int]]) -> DataFrame:
    """df with `problems`: missing result, values outside their enumeration, lists outside their lengths."""
    p = F.col(parsed)
    found = [F.when(p.isNull(), F.lit("missing"))]
    found += [F.when(p.isNotNull() & ~F.coalesce(p[f].isin(v), F.lit(False)), F.lit(f)) for f, v in enums.items()]
    found += [F.when(p.isNotNull() & ~F.coalesce(F.size(p[f]).between(*bounds), F.lit(False)), F.lit(f)) for f, bounds in lists.items()]
    return df.withColumn("problems", F.filter(F.array(*found), lambda x: x.isNotNull()))


def tags(text: Column | str) -> Column:
    """Marks of the form <|TAG|> in order."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("<\\|([A-Za-z_]+)\\|>"), F.lit(1))


def without_tags(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, "<\\|[A-Za-z_]+\\|>", ""))


def frame_maxima(scores: str, names: list[str], triggers: dict[str, float]) -> Column:
    """struct of the largest score by name over an array of frame structs, and the frames above a trigger."""
    s = F.col(scores)
    maxima = [F.array_max(s[name]).alias(name) for name in names]
    hit = lambda x: _any_above(x, triggers)
    return F.struct(*maxima, F.filter(F.transform(s, lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull()).alias("frames"))


def _any_above(x: Column, triggers: dict[str, float]) -> Column:
    out = F.lit(False)
    for name, least in triggers.items():
        out = out | (x[name] > least)
    return out


def coalesce_captions(first: str, second: str, least: int = 10) -> Column:
    """The first caption, or the second where the first is too short."""
    return F.when(F.length(F.trim(F.coalesce(F.col(first), F.lit("")))) >= least, F.col(first)).otherwise(F.coalesce(second, first))


def confidence(text: Column | str) -> Column:
    """A number after `confidence:` as a share of one; percent signs and numbers above one count as percent."""
    raw = F.regexp_extract(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), "confidence\\s*[:：=]\\s*([0-9.]+)", 1).try_cast("double")
    return F.when(raw > 1, raw / 100).otherwise(raw)
