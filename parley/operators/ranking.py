"""Retrieval and ranking: cosine top-k, keyword and hybrid search, rank fusion, rating models, retrieval metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; null if one is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def top_k(df: DataFrame, k: int, score: str, tie: str) -> DataFrame:
    """The k best rows; Spark keeps k per task, so nothing is sorted as a whole."""
    return df.orderBy(F.desc(score), tie).limit(k)


def rank_in(df: DataFrame, keys: list[str], score: str, tie: str, k: int | None = None) -> DataFrame:
    """df with `rank` from 1 within keys; with k only the first k (ranked per task before rows are shuffled)."""
    out = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), tie)))
    return out if k is None else out.where(F.col("rank") <= k)


def keyword_scores(docs: DataFrame, queries: DataFrame, weight: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score): tokens that a query and a document share, by join on the token.

    docs: doc_id, tokens array; queries: query_id, tokens array. weight is an expression over the shared token.
    """
    d = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token"))
    q = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    return d.join(q, "token").groupBy("query_id", "doc_id").agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("score"))


def fuse(rankings: list[DataFrame], keys: list[str], id: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank) over the rankings (keys, id, rank)."""
    out = rankings[0].select(*keys, id, "rank")
    for r in rankings[1:]:
        out = out.union(r.select(*keys, id, "rank"))
    return out.groupBy(*keys, id).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def multi_score(semantic: Column, days_apart: Column, emotion: Column) -> Column:
    """0.5 similarity (0 to 1) + 0.2 nearness in days + 0.3 emotion; nearness is exp(-d/10), 0.1 at least, 0.3 without days."""
    near = F.when(days_apart.isNull(), 0.3).otherwise(F.greatest(F.exp(-days_apart / 10), F.lit(0.1)))
    return 0.5 * F.least(F.greatest(semantic, F.lit(0.0)), F.lit(1.0)) + 0.2 * near + 0.3 * emotion


def priority_union(first: DataFrame, second: DataFrame, id: str, k: int) -> DataFrame:
    """Hits of the first list, then those of the second that are new, k in all; lists have id and rank."""
    both = first.select(id, "rank", F.lit(0).alias("list")).union(second.select(id, "rank", F.lit(1).alias("list")))
    one = both.groupBy(id).agg(F.min(F.struct("list", "rank")).alias("m"))
    return one.orderBy("m.list", "m.rank", id).limit(k).select(id, "m.list", "m.rank")


def fill_quota(ranked: DataFrame, taken: DataFrame, id: str, quota: int, already: str, keys: list[str]) -> DataFrame:
    """Rows to add so that each key has `quota`: best new ones by rank; taken has the keys, ids and is counted by key."""
    have = taken.groupBy(*keys).agg(F.count("*").alias(already))
    fresh = ranked.join(taken.select(id), id, "left_anti").join(have, keys, "left").withColumn(already, F.coalesce(already, F.lit(0)))
    return fresh.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("rank", id))).where(F.col("__r") <= quota - F.col(already)).drop("__r", already)


def focus_lines(df: DataFrame, text: str, words: list[str], k: int, key: str) -> DataFrame:
    """(key, focus): the k lines with most of the words, in their own order, joined by newlines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l, i: F.struct((-sum((F.contains(F.lower(l), F.lit(w)).cast("int") for w in words[1:]), F.contains(F.lower(l), F.lit(words[0])).cast("int"))).alias("minus"), i.alias("i"), l.alias("l"))), lambda x: (F.trim(x["l"]) != "") & (x["minus"] < 0))
    best = F.sort_array(F.transform(F.slice(F.sort_array(lines), 1, k), lambda x: F.struct(x["i"].alias("i"), x["l"].alias("l"))))
    return df.select(key, F.array_join(F.transform(best, lambda x: x["l"]), "\n").alias("focus"))


def retrieval_metrics(hits: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Recall at 3 and 5 and mean reciprocal rank at 10 from (query_id, rank of the first expected hit or null)."""
    r = F.col("rank")
    return hits.groupBy(*keys).agg(F.count("*").alias("queries"), F.avg((F.coalesce(r, F.lit(99)) <= 3).cast("int")).alias("recall3"), F.avg((F.coalesce(r, F.lit(99)) <= 5).cast("int")).alias("recall5"), F.avg(F.when(r <= 10, 1 / r).otherwise(0.0)).alias("mrr10"))


def set_recall(df: DataFrame, delivered: str, gold: str) -> Column:
    return F.size(F.array_intersect(delivered, gold)) / F.size(gold)


def strategy_grid(results: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Mean of the value over every combination of the dimensions, `(all)` where one is rolled up."""
    return results.cube(*dims).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), *[F.grouping(d).alias(f"__{d}") for d in dims]).select(*[F.when(F.col(f"__{d}") == 1, "(all)").otherwise(F.col(d).cast("string")).alias(d) for d in dims], "mean", "n")


def bradley_terry(pairs: DataFrame, rounds: int = 50, floor: float = 100.0) -> DataFrame:
    """(model, rating, interval) from (model_a, model_b, wins_a, wins_b); ties are half a win each before.

    The win table has one row per pair of models; strengths are fitted by the minorisation steps in order of the models'
    names, scaled to a mean of 1000 and bounded below.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        models = sorted(set(rows.model_a) | set(rows.model_b))
        at = {m: k for k, m in enumerate(models)}
        won = np.zeros((len(models), len(models)))
        for r in rows.itertuples():
            won[at[r.model_a], at[r.model_b]] += r.wins_a
            won[at[r.model_b], at[r.model_a]] += r.wins_b
        games, p = won + won.T, np.full(len(models), 1000.0)
        for _ in range(rounds):
            for i in range(len(models)):
                share = sum(games[i, j] / (p[i] + p[j]) for j in range(len(models)) if games[i, j])
                p[i] = max(floor, won[i].sum() / share) if share else p[i]
            p *= 1000.0 / p.mean()
        played = games.sum(axis=1)
        return pd.DataFrame({"model": models, "rating": np.round(p).astype(int), "interval": [2 * round(400 / n**0.5) if n else 0 for n in played]})

    table = pairs.groupBy("model_a", "model_b").agg(F.sum("wins_a").alias("wins_a"), F.sum("wins_b").alias("wins_b"))
    return table.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda g: fit(g), "model string, rating long, interval long")


def rouge_l(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """ROUGE-L F1 over all characters: longest common subsequence by bits of an integer, a column at a time."""

    def one(a: str, b: str) -> float:
        a, b = a or "", b or ""
        if not a or not b:
            return 0.0
        where: dict[str, int] = {}
        for i, c in enumerate(a):
            where[c] = where.get(c, 0) | 1 << i
        full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
        for c in b:
            hit = row & where.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        common = len(a) - row.bit_count()
        return 2 * common / (len(a) + len(b)) if common else 0.0

    return pd.Series([one(a, b) for a, b in zip(reference, hypothesis)])


def rouge_column(reference: Column | str, hypothesis: Column | str) -> Column:
    return F.pandas_udf(rouge_l, "double")(reference, hypothesis)
