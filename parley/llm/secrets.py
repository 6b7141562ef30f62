"""Secrets in texts: three fixed forms, and long tokens that a battery of randomness tests cannot tell from chance.

Everything is DataFrame expressions. Matches of a kind and the texts between them come from one pattern each, and running
sums of their lengths give the places. A token's encoding is inferred from its letters; in that alphabet three statistics
are taken: chi-squared of the symbols against uniformity, runs above and below the middle of the alphabet, and serial
correlation of neighbours. Their p values under chance are combined by Fisher's sum, which is low for random tokens.

How low is low enough is decided for each encoding and class of lengths by false discovery control: the symbols of the text
around a token, as many as the token has, are a decoy that is tested in the same way. Among the tokens up to a score as
many are expected to be false as there are decoys up to it, so the limit is the largest score at which that share is at
most `rate`. Short tokens, where ordinary text passes the tests more easily, so get stricter limits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch

ASSIGN = r"""(?i)(?=[past])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order of the result. A run of letters is as long as can be, so its least length may stand in the pattern;
#: for an assignment it may not, as a short one still covers the text after it.
KINDS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
#: Encodings from narrow to wide: the letters a token may have, and the alphabet in the order of its values.
ENCODINGS = {
    "digits": ("[0-9]", string.digits), "hex": ("[0-9a-f]", string.digits + "abcdef"), "base32": ("[A-Z2-7]", string.ascii_uppercase + "234567"), "base36": ("[0-9a-z]", string.digits + string.ascii_lowercase),
    "base62": ("[0-9A-Za-z]", string.digits + string.ascii_letters), "base64": ("[A-Za-z0-9+/]", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    "base64url": ("[A-Za-z0-9_-]", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"), "other": ("[A-Za-z0-9+/_=-]", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_="),
}
#: Lower ends of the classes of lengths.
CLASSES = (0, 20, 24, 32, 40, 48, 64, 96, 128, 256)
#: Scores are counted in steps of this size; a token looks for its decoy within so many times its length on either side.
STEP, AROUND = 0.25, 16


def _encoding(token: Column) -> Column:
    out = F.lit("other")
    for name, (letters, _) in reversed(ENCODINGS.items()):
        if name != "other":
            fits = token.rlike(f"^{letters}+$")
            out = F.when(fits | token.rlike("^[0-9A-F]+$") if name == "hex" else fits, name).otherwise(out)
    return out


def _alphabet(encoding: Column) -> Column:
    out = F.lit(ENCODINGS["other"][1])
    for name, (_, symbols) in ENCODINGS.items():
        out = F.when(encoding == name, symbols).otherwise(out)
    return out


def _symbols(text: Column, alphabet: Column) -> Column:
    return F.array_join(F.filter(F.split(text, ""), lambda c: (c != "") & (F.instr(alphabet, c) > 0)), "")


def _tail(z: Column) -> Column:
    """The logarithm of the share of a normal distribution above z, by a logistic curve (off by less than 0.0002)."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return -F.log(F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def _statistics(token: str, alphabet: str) -> Column:
    """(z of chi-squared, z of runs, z of serial correlation) of a token of two or more symbols of `alphabet`, two column names."""
    n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
    middle = (k - 1) / 2
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(F.col(token), c, F.lit(""))), F.lit(2.0)))
    neighbours = F.aggregate(
        F.transform(F.split(token, ""), lambda c: F.instr(F.col(alphabet), c) - 1 - middle),
        F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("serial")),
        lambda s, x: F.struct(x.alias("last"), (s["turns"] + F.when((s["last"] > 0) != (x > 0), 1.0).otherwise(0.0)).alias("turns"), (s["serial"] + F.coalesce(s["last"] * x, F.lit(0.0))).alias("serial")),
        lambda s: F.struct(((s["turns"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("runs"), (s["serial"] / ((k * k - 1) / 12 * F.sqrt(n - 1))).alias("serial")),
    )
    return F.struct(((squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("chi"), neighbours.alias("both"))


def _fisher(z: str) -> Column:
    """Fisher's sum over the three tests of _statistics; about 6 for random tokens, more for others."""
    two_sided = lambda c: F.least(F.lit(0.0), F.log(F.lit(2.0)) + _tail(F.abs(c)))
    return F.lit(-2.0) * (_tail(F.col(z)["chi"]) + two_sided(F.col(z)["both"]["runs"]) + two_sided(F.col(z)["both"]["serial"]))


def _matches(kind: int, texts: bool) -> Column:
    """An array of (kind, i, gap, token, before, after) from the columns m<kind>, matches, and p<kind>, the texts between them.

    `gap` is the length of the text since the match before; `before` and `after` are the texts beside it, if `texts`.
    """
    found, pieces = F.col(f"m{kind}").alias("token"), F.col(f"p{kind}")
    zipped = F.arrays_zip(found, pieces.alias("before"), *[F.slice(pieces, 2, F.size(pieces) - 1).alias("after")] * texts)
    reach = lambda s: F.length(s["token"]) * AROUND
    beside = (lambda s: [F.right(s["before"], reach(s)), F.left(s["after"], reach(s))]) if texts else (lambda s: [F.lit(None).cast("string")] * 2)
    row = lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(s["before"]).alias("gap"), s["token"].alias("token"), *[c.alias(name) for c, name in zip(beside(s), ("before", "after"))])
    return F.when(F.size(found) > 0, F.transform(F.slice(zipped, 1, F.size(found)), row)).otherwise(F.array())


def limits(tokens: DataFrame, rate: float) -> DataFrame:
    """(encoding, size_class, limit): the largest step of scores up to which at most `rate` of the tokens are expected to be ordinary text.

    `tokens` has encoding, size_class, step and decoy_step, null where there is no token or decoy. Decoys up to the step,
    and one more, are scaled by the number of tokens to a decoy. The table has a row for each encoding and class at most.
    """
    group = ["encoding", "size_class"]
    counts = tokens.where("step is not null").select(*group, F.explode(F.array(F.struct(F.col("step").alias("s"), F.lit(1).alias("t"), F.lit(0).alias("d")), F.struct(F.col("decoy_step").alias("s"), F.lit(0).alias("t"), F.lit(1).alias("d")))).alias("c"))
    steps = counts.where("c.s is not null").groupBy(*group, "c.s").agg(F.sum("c.t").alias("t"), F.sum("c.d").alias("d"))
    upto, all_of = W.partitionBy(*group).orderBy("s"), W.partitionBy(*group)
    summed = steps.select(*group, "s", F.sum("t").over(upto).alias("t"), F.sum("d").over(upto).alias("d"), F.sum("t").over(all_of).alias("all_t"), F.sum("d").over(all_of).alias("all_d"))
    return summed.where((F.col("d") + 1) * F.col("all_t") <= rate * F.col("t") * F.col("all_d")).groupBy(*group).agg(F.max("s").alias("limit"))


def scan_secrets(spark: SparkSession, docs: DataFrame, rate: float = 0.05, least: int = 20) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): secrets in the whole text of every row of `docs` (doc_id, text).

    The fixed kinds are matched leftmost and without overlap, each by itself: `assign`, a name such as password or api_key
    in either case before a value of 6 or more characters; `access`, AKIA and capitals or digits, 20 or more; `hex`, 24 or
    more hexadecimal digits. `random` are runs of `least` or more of A-Z a-z 0-9 + / _ = - whose score is within the limit
    of their encoding and length, and which no span of the fixed kinds overlaps; closing `=` are not tested. `spans` has
    kind:start:end of all, in code points with the end exclusive, by start and then in this order of kinds, joined by
    commas; `base_sha256` is the digest of the same string of the fixed kinds alone.

    A class of tokens without decoys, or with too few tokens for `rate`, adds nothing. A null or empty text has no spans;
    every row of the input has a row of the result, repeated and null doc_ids too. An empty table gives an empty result.
    Other columns of the input are left out. Only matches are shuffled, by the row they stand in, so one group is no larger
    than one text; limits are broadcast, a row for each encoding and class of lengths at most.
    """
    scratch = Scratch(spark, "secrets")
    patterns = [*KINDS.values(), f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{least},}}+"]
    last = len(KINDS)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    matched = texts.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(patterns)])
    cut = matched.select("*", *[F.when(F.size(f"m{k}") > 0, F.split("text", p)).alias(f"p{k}") for k, p in enumerate(patterns)]).drop("text")
    rows = cut.select("row", "doc_id", F.explode_outer(F.concat(*[_matches(k, k == last) for k in range(len(patterns))])).alias("m")).select("row", "doc_id", "m.*")

    body = rows.withColumn("body", F.when(F.col("kind") == last, F.regexp_replace("token", "=+$", "")))
    coded = body.withColumn("encoding", F.when(F.length("body") >= 2, _encoding(F.col("body"))))
    # in an encoding of one case the text around a token is read in that case
    folded = lambda c: F.when(F.col("encoding").isin("hex", "base36"), F.lower(c)).when(F.col("encoding") == "base32", F.upper(c)).otherwise(F.col(c))
    coded = coded.withColumns({c: folded(c) for c in ("body", "before", "after")}).withColumn("alphabet", F.when(F.col("encoding").isNotNull(), _alphabet(F.col("encoding"))))
    n = F.length("body")
    near = coded.withColumn("left", _symbols(F.col("before"), F.col("alphabet"))).withColumn("around", F.concat("left", _symbols(F.col("after"), F.col("alphabet"))))
    near = near.withColumn("decoy", F.when(F.length("left") >= n, F.right("left", n)).when(F.length("around") >= n, F.left("around", n)))
    tested = near.withColumns({f"z_{c}": F.when(F.col(c).isNotNull() & F.col("alphabet").isNotNull(), _statistics(c, "alphabet")) for c in ("body", "decoy")})
    step = lambda c: F.when(F.col(f"z_{c}").isNotNull(), F.floor(_fisher(f"z_{c}") / STEP).cast("int"))
    size_class = F.lit(0)
    for least_length in CLASSES[1:]:
        size_class = F.when(n >= least_length, least_length).otherwise(size_class)
    holds = F.when(F.col("kind") == 0, F.length(F.regexp_extract("token", ASSIGN, 2)) >= 6).otherwise(F.col("kind").isNotNull())
    tokens = scratch.write(
        tested.select("row", "doc_id", "kind", "i", (F.col("gap") + F.length("token")).cast("long").alias("reach"), F.length("token").alias("long"), holds.alias("holds"), "encoding", size_class.alias("size_class"), step("body").alias("step"), step("decoy").alias("decoy_step")),
        "tokens",
    )

    limit = scratch.write(limits(tokens, rate), "limits")
    end = F.sum("reach").over(W.partitionBy("row", "kind").orderBy("i"))
    placed = tokens.join(F.broadcast(limit), ["encoding", "size_class"], "left").repartition("row").withColumn("end", end).withColumn("start", F.col("end") - F.col("long"))
    order = W.partitionBy("row").orderBy("start")
    base = F.col("holds") & (F.col("kind") < last)
    ended = F.max(F.when(base, F.col("end"))).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    begins = F.min(F.when(base, F.col("start"))).over(order.rangeBetween(W.currentRow, W.unboundedFollowing))
    free = (F.col("kind") == last) & (F.col("step") <= F.col("limit")) & ~F.coalesce(ended > F.col("start"), F.lit(False)) & ~F.coalesce(begins < F.col("end"), F.lit(False))
    marked = placed.select("row", "doc_id", "kind", F.struct("start", "kind", "end").alias("span"), base.alias("base"), F.coalesce(free, F.lit(False)).alias("free"))
    spelled = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, [*KINDS, "random"])), s["kind"] + 1), s["start"], s["end"])), ",")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    grouped = marked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts, F.collect_list(F.when(F.col("base"), F.col("span"))).alias("base"), F.collect_list(F.when(F.col("base") | F.col("free"), F.col("span"))).alias("all"))
    scratch.close(tokens, limit)
    return grouped.select("doc_id", *[f"n_{name}" for name in KINDS], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("all")).alias("spans"))
