"""Aggregations and reports: one pass each, with grouping sets where several group-bys are reported together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import contains_any, labels_present, present_words


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) for each column and `total`, by grouping sets over one scan."""
    cols = {c: F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in columns}
    rows = df.select(*[v.alias(c) for c, v in cols.items()])
    sets = [[F.col(c)] for c in columns] + [[]]
    grouped = rows.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id(*columns).alias("g"))
    full = (1 << len(columns)) - 1
    which = F.lit("total")
    for i, c in enumerate(columns):
        which = F.when(F.col("g") == full & ~(1 << (len(columns) - 1 - i)), c).otherwise(which)
    return grouped.select(which.alias("dimension"), F.coalesce(*columns, F.lit("")).alias("value"), "n")


def coverage(df: DataFrame) -> DataFrame:
    """(field, coverage): share of rows with a value that is neither null nor empty, of each column."""
    filled = [F.avg((F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != "")).cast("int")).alias(c) for c in df.columns]
    one = df.agg(*filled)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("coverage")) for c in df.columns])).alias("x")).select("x.field", "x.coverage")


def compression(df: DataFrame, before: str, after: str, keys: list[str]) -> DataFrame:
    """Sizes before and after, average and extreme ratios (2 decimals), percent saved (1 decimal)."""
    ratio = F.col(before) / F.col(after)
    return df.where(F.col(after) > 0).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(before).alias("before"), F.sum(after).alias("after"), F.round(F.avg(ratio), 2).alias("avg_ratio"), F.round(F.max(ratio), 2).alias("max_ratio"), F.round(F.min(ratio), 2).alias("min_ratio"),
        F.round((1 - F.sum(after) / F.sum(before)) * 100, 1).alias("saved_percent"),
    )


def entity_table(df: DataFrame, entity: str, context: str, order: str, contexts: int = 3, chars: int = 100) -> DataFrame:
    """(entity, n, contexts): frequency and the first few contexts; counts are summed, contexts ranked, before they meet."""
    n = df.groupBy(entity).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(entity).orderBy(order))
    first = df.withColumn("__r", rank).where(F.col("__r") <= contexts).groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("__r", F.left(F.col(context), F.lit(chars)).alias("c")))).alias("c"))
    return n.join(first, entity).select(entity, "n", F.transform("c", lambda x: x["c"]).alias("contexts"))


def response_stats(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Average and largest response time of ME and OTHER, and (other - me) / max of the averages; null without both."""
    of = lambda s: F.when(F.col("speaker") == s, F.col("seconds"))
    g = answers.groupBy(*keys).agg(F.avg(of("ME")).alias("me_avg"), F.max(of("ME")).alias("me_max"), F.avg(of("OTHER")).alias("other_avg"), F.max(of("OTHER")).alias("other_max"))
    return g.withColumn("asymmetry", (F.col("other_avg") - F.col("me_avg")) / F.nullif(F.greatest("me_avg", "other_avg"), F.lit(0)))


def label_shares(df: DataFrame, text: str, lexicon: dict[str, list[str]], least: float = 0.1, most: int = 3) -> DataFrame:
    """(label, hits, share): rows per label and share of all hits; the `most` largest shares above `least`, first declared first."""
    order = {label: k for k, label in enumerate(lexicon)}
    hits = df.select(F.explode(labels_present(text, lexicon)).alias("label")).groupBy("label").agg(F.count("*").alias("hits"))
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("label"))
    shared = hits.withColumn("share", F.col("hits") / F.sum("hits").over(W.partitionBy(F.lit(0))))  # a row per label
    return shared.where(F.col("share") > least).orderBy(F.desc("share"), place).limit(most)


def top_labels(df: DataFrame, text: str, lexicon: dict[str, list[str]], seq: str, most: int, least: int = 1) -> DataFrame:
    """(label, n) of the `most` frequent labels with `least` rows; ties by first occurrence."""
    g = df.select(seq, F.explode(labels_present(text, lexicon)).alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return g.where(F.col("n") >= least).orderBy(F.desc("n"), "first").limit(most)


def trend(df: DataFrame, keys: list[str], text: str, order: list[str], positive: list[str], negative: list[str], margin: int = 3) -> DataFrame:
    """improving, declining or stable per key: score of the second half of rows less that of the first; below 3 rows stable."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    n = F.count("*").over(W.partitionBy(*keys))
    late = place > F.floor(n / 2)
    value = present_words(text, positive) - present_words(text, negative)
    g = df.withColumn("__v", F.when(late, value).otherwise(-value)).withColumn("__n", n).groupBy(*keys).agg(F.sum("__v").alias("change"), F.first("__n").alias("n"))
    return g.select(*keys, "n", "change", F.when(F.col("n") < 3, "stable").when(F.col("change") > margin, "improving").when(F.col("change") < -margin, "declining").otherwise("stable").alias("trend"))


def styles(df: DataFrame, keys: list[str], text: str, emoji: str = "[\\x{1F300}-\\x{1FAFF}❤]") -> DataFrame:
    """Average length, emoji per line and a label: verbose above 50, brief below 10, expressive above 0.3 emoji, else balanced."""
    g = df.groupBy(*keys).agg(F.avg(F.length(F.coalesce(text, F.lit("")))).alias("avg_chars"), F.avg(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(emoji))).alias("emoji"))
    return g.withColumn("style", F.when(F.col("avg_chars") > 50, "verbose").when(F.col("avg_chars") < 10, "brief").when(F.col("emoji") > 0.3, "expressive").otherwise("balanced"))


def annotator_consistency(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean absolute difference of the paired scores per session and its label: high to 1, medium to 2, else low."""
    apart = sum((F.abs(F.col(a) - F.col(b)) for a, b in pairs[1:]), F.abs(F.col(pairs[0][0]) - F.col(pairs[0][1]))) / len(pairs)
    g = df.groupBy(*keys).agg(F.avg(apart).alias("difference"), F.count("*").alias("n"))
    return g.withColumn("consistency", F.when(F.col("difference") <= 1, "high").when(F.col("difference") <= 2, "medium").otherwise("low"))


def dimension_stats(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, dimension, n, mean, sd): sample deviation, 0 for a single value; null if there is none."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*keys, "x.*")
    g = long.groupBy(*keys, "dimension").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return g.withColumn("sd", F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd")))


def wins(battles: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, model, battles, wins, win_rate): each battle counts for both sides; a tie is nobody's win."""
    sides = F.array(F.struct(F.col("model_a").alias("model"), (F.col("vote") == "a_win").cast("int").alias("win")), F.struct(F.col("model_b").alias("model"), (F.col("vote") == "b_win").cast("int").alias("win")))
    long = battles.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    return long.groupBy(*keys, "model").agg(F.count("*").alias("battles"), F.sum("win").alias("wins")).withColumn("win_rate", F.col("wins") / F.col("battles"))


def percentiles(df: DataFrame, value: str, shares: list[float], keys: list[str] = ()) -> DataFrame:
    """Exact percentiles by linear interpolation, as columns p50, p95 and so on."""
    return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(f"p{p * 100:g}") for p in shares])


def kpis(sessions: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Named aggregates of sessions in one pass."""
    return sessions.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def pivot_counts(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts with a column per value; the values are given, so no extra job finds them."""
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).fillna(0, values)


def costs(df: DataFrame, day: str, cost: str, budget: float) -> DataFrame:
    """(day, spent, month_spent, left): daily sums, running sums of the month, what is left of the monthly budget."""
    g = df.groupBy(F.to_date(day).alias("day")).agg(F.sum(cost).alias("spent"))
    month = W.partitionBy(F.trunc("day", "month")).orderBy("day")
    return g.withColumn("month_spent", F.sum("spent").over(month)).withColumn("left", budget - F.col("month_spent"))


def leaks(df: DataFrame, text: str, names: list[str], around: int = 20) -> DataFrame:
    """(name, context) for every row in which a name occurs: `around` characters on both sides of the first place."""
    found = df.where(contains_any(text, names)).select("*", F.explode(F.array(*[F.lit(n) for n in names])).alias("name")).withColumn("__at", F.expr(f"instr({text}, name)")).where("__at > 0")
    start = F.greatest(F.col("__at") - around, F.lit(1))
    return found.withColumn("context", F.substring(F.col(text), start, F.col("__at") + F.length("name") + around - start)).drop("__at")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def evolution(df: DataFrame, keys: list[str], labels: str, order: list[str]) -> DataFrame:
    """Labels of the last row that the first lacks, and the reverse, per key."""
    g = df.groupBy(*keys).agg(F.min_by(labels, F.struct(*order)).alias("first"), F.max_by(labels, F.struct(*order)).alias("last"))
    return g.select(*keys, F.array_sort(F.array_except("last", "first")).alias("emerged"), F.array_sort(F.array_except("first", "last")).alias("faded"))


def neutrality(df: DataFrame, key: str, text: str, criticism: str, first: str, second: str) -> DataFrame:
    """Critical sentences about each party and 1 - 2 |share - 0.5|; 1 if there is no criticism."""
    s = df.select(key, F.explode(F.split(F.coalesce(text, F.lit("")), "[.!?。！？\\n]+")).alias("s")).where("trim(s) <> ''")
    bad = F.col("s").rlike(criticism)
    g = s.groupBy(key).agg(F.count_if(bad & F.col("s").rlike(first)).alias("about_first"), F.count_if(bad & F.col("s").rlike(second)).alias("about_second"))
    total = F.col("about_first") + F.col("about_second")
    return g.withColumn("neutrality", F.when(total == 0, 1.0).otherwise(1 - 2 * F.abs(F.col("about_first") / total - 0.5)))
