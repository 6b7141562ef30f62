"""The thin queries of the operators over the supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import ann, bpe, codebooks, hard_negatives, jaccard_join, lattice_lm, licenses, line_dedup, mixing, pii, secrets, simhash, toxicity

#: Files of public tokenizers; a path every executor has.
BPE_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")
#: A key for these synthetic tables only, so that reruns agree; real data need a secret one.
PII_KEY = b"key of the synthetic tables"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    out = jaccard_join.jaccard_components(spark, _table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, lines removed as repeats, and the digest of what is left."""
    out = line_dedup.drop_repeated_lines(spark, _table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of each document."""
    return licenses.scan_licenses(spark, _table(spark, sf_dir, "documents"), keep_spans=False).drop("spans")


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and subword lattice score of each document."""
    return lattice_lm.score_texts(spark, _table(spark, sf_dir, "documents"), PIECES_FILE)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its personal data under pseudonyms."""
    return pii.pseudonymise_texts(spark, _table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "n_found", "kinds", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes of each document."""
    out = mixing.mix(spark, _table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of the text decoded from them."""
    return bpe.encode_texts(spark, _table(spark, sf_dir, "documents"), BPE_FILE, keep=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and classes of near fingerprints."""
    return simhash.edited_neighbours(spark, _table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(spark, vectors, vectors.where("vec_id % 50 = 0"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from the labels outside the fold that is held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grammar = toxicity.learn(spark, docs, labels)
    out = toxicity.score_toxicity(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), grammar)
    return out.select("doc_id", lattice_lm.held_out(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors after two rounds over codebooks of 64 entries for each of 16 parts."""
    return codebooks.elkan_codes(spark, _table(spark, sf_dir, "embeddings")).drop("label")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50; every seventh label is moved to the next class."""
    e = _table(spark, sf_dir, "embeddings")
    moved = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(spark, moved, e.where("vec_id % 50 = 0").select("vec_id"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of fixed forms in each document, and tokens that look random."""
    return secrets.scan_secrets(spark, _table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_line_dedup, op3_license_scan, op4_lattice_lm, op5_pii, op6_mixing, op7_bpe, op8_simhash, op9_ann, op10_toxicity, op11_codebooks, op12_hard_negatives, op13_secrets)}

#: The rows that take part, with integer components.
_WHOLE = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _codebooks_sql(rounds: int = 2) -> str:
    """Lloyd's rounds, unrolled."""
    near = "SELECT vec_id, part, entry, d FROM (SELECT c.vec_id, c.part, b.entry, sum((c.x - b.y) * (c.x - b.y)) AS d FROM c JOIN b{0} b USING (part, place) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1"
    mean = "SELECT b.part, b.entry, b.place, coalesce(m.y, b.y) AS y FROM b{0} b LEFT JOIN (SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS y FROM c JOIN a{0} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, place)"
    steps = ",\n".join(f"a{i} AS MATERIALIZED ({near.format(i)}),\nb{i + 1} AS MATERIALIZED ({mean.format(i)})" for i in range(rounds))
    return f"""
WITH k AS ({_WHOLE}),
c AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(v) // 16) AS part, (i - 1) % (len(v) // 16) AS place, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM k)),
b0 AS MATERIALIZED (SELECT part, entry, place, x AS y FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64) USING (vec_id)),
{steps},
last AS ({near.format(rounds)}),
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
FROM r JOIN k USING (vec_id)
"""


def _secrets_sql(rate: float = 0.05, least: int = 20) -> str:
    """The three fixed kinds, the tests of long tokens and their decoys, and the limits of their scores."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = f"({names})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    patterns = [assign, *list(secrets.KINDS.values())[1:], f"[A-Za-z0-9+/_=-]{{{least},}}"]
    last = len(secrets.KINDS)
    matches = " UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all(text, '{p}', 0) AS ms, string_split_regex(text, '{p}') AS ps FROM t" for k, p in enumerate(patterns))
    encoding = " ".join(f"WHEN regexp_full_match(body, '{letters}+'){' OR regexp_full_match(body, $$[0-9A-F]+$$)' if name == 'hex' else ''} THEN '{name}'" for name, (letters, _) in secrets.ENCODINGS.items())
    alphabet = " ".join(f"WHEN '{name}' THEN '{symbols}'" for name, (_, symbols) in secrets.ENCODINGS.items())
    symbols = " ".join(f"WHEN '{name}' THEN regexp_replace({{0}}, '[^{letters[1:-1]}]', '', 'g')" for name, (letters, _) in secrets.ENCODINGS.items())
    fold = "CASE WHEN encoding IN ('hex', 'base36') THEN lower({0}) WHEN encoding = 'base32' THEN upper({0}) ELSE {0} END"
    classes = " ".join(f"WHEN length(body) >= {c} THEN {c}" for c in reversed(secrets.CLASSES))
    z = "greatest(-8.0::DOUBLE, least(8.0::DOUBLE, {0}))"
    tail = f"(-ln(1 + exp(1.5976::DOUBLE * {z} + 0.07056::DOUBLE * {z} * {z} * {z})))"
    two = f"least(0.0::DOUBLE, ln(2.0::DOUBLE) + {tail.format('abs({0})')})"
    kinds = ", ".join(f"'{name}'" for name in [*secrets.KINDS, "random"])
    counts = ", ".join(f"count(*) FILTER (kind = {k} AND base) AS n_{name}" for k, name in enumerate(secrets.KINDS))
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
k AS ({matches}),
m AS (SELECT r, kind, i, ms[i] AS token, ps[i] AS before, ps[i + 1] AS after, length(ps[i]) + length(ms[i]) AS reach FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM k)),
p AS MATERIALIZED (SELECT r, kind, token, before, after, e - length(token) AS s, e, kind < {last} AND (kind > 0 OR length(regexp_extract(token, '{assign}', 2)) >= 6) AS base FROM (SELECT *, sum(reach) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM m)),
c AS (SELECT *, CASE {encoding} END AS encoding FROM (SELECT r, s, e, right(before, {secrets.AROUND} * length(token)) AS before, left(after, {secrets.AROUND} * length(token)) AS after, regexp_replace(token, '=+$', '') AS body FROM p WHERE kind = {last}) WHERE length(body) >= 2),
f AS (SELECT r, s, e, encoding, {fold.format('body')} AS body, {fold.format('before')} AS before, {fold.format('after')} AS after, CASE encoding {alphabet} END AS alphabet, CASE {classes} END AS size_class FROM c),
g AS (SELECT *, CASE encoding {symbols.format('before')} END AS l, l || CASE encoding {symbols.format('after')} END AS a FROM f),
x AS (SELECT r, s, e, encoding, size_class, alphabet, unnest([0, 1]) AS decoy, unnest([body, CASE WHEN length(l) >= length(body) THEN right(l, length(body)) WHEN length(a) >= length(body) THEN left(a, length(body)) END]) AS x FROM g),
v AS (SELECT *, length(x)::DOUBLE AS n, length(alphabet)::DOUBLE AS k, list_sum(list_transform(string_split(alphabet, ''), lambda ch: (length(x) - length(replace(x, ch, ''))) ** 2))::DOUBLE AS squares, list_transform(string_split(x, ''), lambda ch: instr(alphabet, ch) - 1 - (length(alphabet)::DOUBLE - 1) / 2) AS v FROM x WHERE x IS NOT NULL),
w AS (SELECT *, (squares * k / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS chi,
  (list_sum(list_transform(range(1, len(v)), lambda i: ((v[i] > 0) <> (v[i + 1] > 0))::INT))::DOUBLE - (n - 1) / 2) / sqrt((n - 1) / 4) AS runs, list_sum(list_transform(range(1, len(v)), lambda i: v[i] * v[i + 1])) / ((k * k - 1) / 12 * sqrt(n - 1)) AS serial FROM v),
y AS MATERIALIZED (SELECT r, s, e, encoding, size_class, decoy, floor(-2.0::DOUBLE * ({tail.format('chi')} + {two.format('runs')} + {two.format('serial')}) / {secrets.STEP}::DOUBLE) AS step FROM w),
h AS (SELECT encoding, size_class, step, count(*) FILTER (decoy = 0) AS t, count(*) FILTER (decoy = 1) AS d FROM y GROUP BY ALL),
u AS (SELECT encoding, size_class, step, sum(t) OVER o AS t, sum(d) OVER o AS d, sum(t) OVER q AS all_t, sum(d) OVER q AS all_d FROM h WINDOW o AS (PARTITION BY encoding, size_class ORDER BY step), q AS (PARTITION BY encoding, size_class)),
lim AS (SELECT encoding, size_class, max(step) AS top FROM u WHERE (d + 1) * all_t <= {rate}::DOUBLE * t * all_d GROUP BY ALL),
found AS (SELECT r, s, e, kind, true AS base FROM p WHERE base UNION ALL
  SELECT r, s, e, {last}, false FROM y JOIN lim USING (encoding, size_class) WHERE decoy = 0 AND step <= top AND NOT EXISTS (SELECT 1 FROM p WHERE p.base AND p.r = y.r AND p.s < y.e AND y.s < p.e)),
spelled AS (SELECT *, [{kinds}][kind + 1] || ':' || s || ':' || e AS span FROM found),
o AS (SELECT r, {counts}, string_agg(span, ',' ORDER BY s, kind) FILTER (base) AS fixed, string_agg(span, ',' ORDER BY s, kind) AS spans FROM spelled GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{name}, 0) AS n_{name}' for name in secrets.KINDS)}, sha256(coalesce(fixed, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN o USING (r)
"""


ORACLES = {
    "op13_secrets": _secrets_sql(),
    "op11_codebooks": _codebooks_sql(),
    "op12_hard_negatives": f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v::DOUBLE[] AS v FROM ({_WHOLE}) WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
""",
    "op1_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(ws, ' ') AS g FROM w WHERE len(ws) BETWEEN 1 AND 2
    UNION ALL
    SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3))
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
c AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT l.b, c.root FROM c JOIN links l ON l.a = c.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c.root) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.doc_id = w.doc_id GROUP BY w.doc_id
""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [1.0, 2.0, 3.0]::DOUBLE[] AS ws, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM d GROUP BY source
), weighed AS (SELECT source, source_size, ws[(turn % 3 + 1)::INT] AS w, 3.0::DOUBLE * source_size AS cap FROM s),
leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), t AS (
  SELECT source, source_size, CASE WHEN cap > level * w THEN (max(CASE WHEN cap > level * w THEN level END) OVER ()) * w ELSE cap END AS target FROM leveled
), g AS (
  SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS cum FROM d GROUP BY source, h
), e AS (
  SELECT g.source, g.h, floor(t.target / t.source_size) AS whole, g.cum - g.n + g.n / 2.0 <= t.target - floor(t.target / t.source_size) * t.source_size AND NOT g.cum - g.n > t.target - floor(t.target / t.source_size) * t.source_size AS more
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source WHERE t.source_size > 0
)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * least(3, coalesce(e.whole + e.more::INT, 0)))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.h = d.h
""",
}
