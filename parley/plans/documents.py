"""Queries over documents, pages, labels and benchmark: text measures, cleaning, privacy, lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import joins, media, messages, names, privacy, reports
from parley.plans.catalogue import query
from parley.plans.messages import BAD, GOOD, LABELS, _any, _present
from parley.plans.tables import table

#: Patterns of the corpus: both engines' regular expressions know them.
PATTERNS = {"EMAIL": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "IP": "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}", "LONG_NUMBER": "[0-9]{13,19}"}


def _count(c: str, p: str) -> str:
    return f"len(regexp_extract_all(coalesce({c}, ''), '{p}'))"


@query(f"SELECT doc_id, {', '.join(_count('text', p) + '::INT AS ' + k for k, p in PATTERNS.items())} FROM documents")
def pii_counts(spark, sf_dir):
    """Matches by type."""
    return table(spark, sf_dir, "documents").select("doc_id", privacy.pii_counts("text", PATTERNS).alias("c")).select("doc_id", "c.*")


#: All patterns as one, and the kind of a match.
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
_kind = lambda v: "CASE " + " ".join(f"WHEN regexp_full_match({v}, '{p}') THEN '{k}'" for k, p in PATTERNS.items()) + " END"


@query(f"""WITH c AS (SELECT doc_id, string_split_regex(text, '{_ALL}') AS ps, regexp_extract_all(text, '{_ALL}') AS ms FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce('[' || {_kind('ms[i]')} || ']', '')), '')) AS digest FROM c""")
def pii_redact(spark, sf_dir):
    """Matches by placeholders."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(privacy.redact("text", PATTERNS)).alias("digest"))


@query(f"""WITH c AS (SELECT doc_id, string_split_regex(text, '{_ALL}') AS ps, regexp_extract_all(text, '{_ALL}') AS ms FROM documents),
m AS (SELECT doc_id, i, ms[i] AS v, length(ps[i]) + length(ms[i]) AS n FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM c)),
e AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM m)
SELECT doc_id, e - length(v) AS start, e AS "end", {_kind('v')} AS type, v AS value FROM e""")
def pii_places(spark, sf_dir):
    """Matches of all types in one reading, with their places."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(privacy.pii_spans("text", PATTERNS, overlaps="first")).alias("s"))
    return found.select("doc_id", "s.*")


#: Names: the longer words of the benchmark, each with the word that a reader sees instead.
_NAMES = "SELECT DISTINCT w AS text, 'N' || length(w) AS code FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark) WHERE length(w) >= 6"


@query(f"""WITH n AS ({_NAMES}),
c AS (SELECT doc_id, string_split_regex(text, '[\\p{{L}}\\p{{N}}_]+') AS ps, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS ms FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, ps[i] AS p, ms[i] AS v FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM c))
SELECT doc_id, count(n.code)::INT AS replaced, md5(string_agg(p || coalesce('[' || n.code || ']', v, ''), '' ORDER BY i)) AS digest FROM w LEFT JOIN n ON n.text = lower(v) GROUP BY doc_id""")
def names_from_table(spark, sf_dir):
    """Names of a table as one dictionary; whole words in any case, by their code."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))).alias("text")).distinct().where("length(text) >= 6")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    out = names.replace_names(docs, "doc_id", "text", words.withColumn("code", F.concat(F.lit("N"), F.length("text"))), borders=True, ignore_case=True)
    return out.select("doc_id", "replaced", F.md5("text").alias("digest"))


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest(regexp_extract_all(text, '{p}')) AS v FROM documents" for k, p in PATTERNS.items()) + ") SELECT type, count(*) AS matches, count(DISTINCT v) AS values, count(DISTINCT doc_id) AS messages FROM m GROUP BY type")
def pii_scan(spark, sf_dir):
    """matches, values and documents by type."""
    return privacy.scan_report(table(spark, sf_dir, "documents"), "doc_id", "text", PATTERNS)


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\\p{P}\\p{S}]', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def punct_normalise(spark, sf_dir):
    """Punctuation to space."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.punctuation_to_space("text")).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\x{FFFD}\\p{Co}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g')) AS digest FROM documents WHERE regexp_replace(text, '[\\x{FFFD}\\p{Co}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g') <> ''")
def unicode_clean(spark, sf_dir):
    """Control, private and replacement characters out."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_unicode("text")).alias("digest")).where("digest is not null")


@query("""WITH w AS (SELECT doc_id, length(trim(text, ' ')) AS l, unnest(string_split_regex(text, '\\s+')) AS w FROM documents), c AS (SELECT doc_id, any_value(l) AS l, w, count(*) AS n FROM w WHERE w <> '' GROUP BY doc_id, w), g AS (SELECT doc_id, any_value(l) AS l, max(n) AS m, sum(n) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.l >= 10 AND g.n >= 4 AND g.m / g.n > 0.5, false) AS repetitive FROM documents d LEFT JOIN g USING (doc_id)""")
def repetitive_text(spark, sf_dir):
    """Texts of which one word is more than half."""
    # a word that is more than half of all stands in the middle of the sorted words: nothing is shuffled
    words = F.sort_array(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length(F.trim("text")).alias("l"), F.array(words).alias("once"))
    most = F.transform("once", lambda w: F.when((F.size(w) >= 4) & F.col("doc_id").isNotNull(), F.size(F.filter(w, lambda x: x == F.get(w, (F.size(w) / 2).cast("int")))) / F.size(w)))[0]
    return rows.select("doc_id", F.coalesce((F.col("l") >= 10) & (most > 0.5), F.lit(False)).alias("repetitive"))


@query("SELECT doc_id, floor(length(text) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    """Estimated tokens; the corpus has no Han characters."""
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens("text").alias("tokens"))


@query("""WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM w""")
def distinct_words(spark, sf_dir):
    """Words without repeats, in order."""
    return table(spark, sf_dir, "benchmark").select("item_id", X.distinct_words("text").alias("words"))


@query(f"SELECT doc_id, list_filter([{', '.join(f'CASE WHEN {_any(chr(116) + chr(101) + chr(120) + chr(116), w)} THEN {chr(39)}{k}{chr(39)} END' for k, w in LABELS.items())}], lambda x: x IS NOT NULL) AS labels FROM documents")
def lexicon_tags(spark, sf_dir):
    """Labels of which a word occurs."""
    return table(spark, sf_dir, "documents").select("doc_id", X.labels_present("text", LABELS).alias("labels"))


@query(f"WITH s AS (SELECT doc_id, {_present('text', BAD)} AS b, {_present('text', GOOD)} AS g FROM documents) SELECT doc_id, CASE WHEN b + g = 0 THEN 0 ELSE (g - b) / (g + b) END AS sentiment FROM s")
def sentiment(spark, sf_dir):
    """Words of both kinds present."""
    return table(spark, sf_dir, "documents").select("doc_id", X.sentiment("text", BAD, GOOD).alias("sentiment"))


@query(f"""WITH s AS (SELECT doc_id, {', '.join(f"{_present('text', w)} * 3 AS {k}" for k, w in LABELS.items())} FROM documents), t AS (SELECT *, greatest({', '.join(LABELS)}) AS best, {' + '.join(LABELS)} AS total FROM s)
SELECT doc_id, CASE WHEN total = 0 THEN 'none' {' '.join(f"WHEN {k} = best THEN '{k}'" for k in LABELS)} END AS intent, CASE WHEN total = 0 THEN 0.5 ELSE best / total END AS confidence FROM t""")
def intent_argmax(spark, sf_dir):
    """The label with the largest score and its share."""
    scores = {k: X.present_words("text", w) * 3 for k, w in LABELS.items()}
    d = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in scores.items()])
    total = sum((F.col(k) for k in list(LABELS)[1:]), F.col(list(LABELS)[0]))
    best = X.argmax_label({k: F.col(k) for k in LABELS})
    return d.select("doc_id", F.when(total == 0, "none").otherwise(best).alias("intent"), F.when(total == 0, 0.5).otherwise(F.greatest(*LABELS) / total).alias("confidence"))


@query("""WITH p AS (SELECT a.item_id, a.text AS a, b.text AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), c AS (SELECT item_id, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM p)
SELECT item_id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS jaccard FROM c""")
def char_jaccard(spark, sf_dir):
    """Similarity of the sets of characters of neighbours."""
    b = table(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", X.char_jaccard("text", "other").alias("jaccard"))


@query("""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))) AS digest FROM t""")
def html_strip(spark, sf_dir):
    """Text of pages."""
    from parley.sources.files import strip_html

    return table(spark, sf_dir, "pages").select("page_id", F.md5(strip_html("html")).alias("digest"))


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'm.') AND contains(lower(url), '//m.') THEN 'mobile' WHEN contains(lower(url), '.org') THEN 'organisation' WHEN contains(lower(url), '.net') THEN 'network' ELSE 'web' END AS kind FROM pages""")
def link_type(spark, sf_dir):
    """The first rule of which a part occurs."""
    rules = {"mobile": ["//m."], "organisation": [".org"], "network": [".net"]}
    return table(spark, sf_dir, "pages").select("page_id", media.link_type("url", rules).alias("kind"))


@query("""SELECT p_partkey, CASE WHEN p_size * 300 < 5120 THEN 'SKIP' WHEN greatest(p_size * 8, p_retailprice) < 64 THEN 'SKIP' WHEN greatest(p_size * 8, p_retailprice) / greatest(least(p_size * 8, p_retailprice), 1) > 5 AND greatest(p_size * 8, p_retailprice) > 5000 THEN 'SLICE'
WHEN greatest(p_size * 8, p_retailprice) < 300 THEN 'LITE' ELSE 'FULL' END AS tier FROM part""")
def media_tier(spark, sf_dir):
    """Tier by size and dimensions."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", media.image_tier(F.col("p_size") * 8, F.col("p_retailprice"), F.col("p_size") * 300)["tier"].alias("tier"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 OR o_custkey % 50 >= 40 THEN 'text' WHEN o_custkey % 50 <= 3 AND o_totalprice < 50000 THEN 'picture' ELSE 'mixed' END AS class FROM orders")
def page_class(spark, sf_dir):
    """Class by two measures."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", media.page_class(F.col("o_custkey") % 50, "o_totalprice", 3, 40, 50000, 200000.0000001).alias("class"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN 'FULL' WHEN c_acctbal > 0 THEN 'LITE' ELSE 'SKIP' END AS tier, 'other' AS category, c_name AS name FROM customer")
def file_category(spark, sf_dir):
    """Names, categories and tiers."""
    c = table(spark, sf_dir, "customer")
    tier = F.when(F.col("c_acctbal") > 8000, "FULL").when(F.col("c_acctbal") > 0, "LITE").otherwise("SKIP")
    return c.select("c_custkey", tier.alias("tier"), media.file_category("c_name").alias("category"), media.file_name("c_name", F.lit("a/b.txt")).alias("name"))


@query("""SELECT 'c_custkey' AS field, avg((c_custkey IS NOT NULL)::INT) AS coverage FROM customer UNION ALL SELECT 'c_name', avg((coalesce(c_name, '') <> '')::INT) FROM customer UNION ALL SELECT 'c_nationkey', avg((c_nationkey IS NOT NULL)::INT) FROM customer
UNION ALL SELECT 'c_acctbal', avg((c_acctbal IS NOT NULL)::INT) FROM customer UNION ALL SELECT 'c_mktsegment', avg((coalesce(c_mktsegment, '') <> '')::INT) FROM customer""")
def field_coverage(spark, sf_dir):
    """filled share of each column."""
    return reports.coverage(table(spark, sf_dir, "customer"))


@query("""WITH q AS (SELECT doc_id, text FROM documents WHERE contains(lower(text), 'license')), p AS (SELECT *, strpos(lower(text), 'license') AS pos FROM q) SELECT doc_id, substr(lower(text), greatest(pos - 40, 1), pos + 47 - greatest(pos - 40, 1)) AS excerpt FROM p""")
def session_search(spark, sf_dir):
    """Documents with a substring and the text around it."""
    d = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return d.select("doc_id", X.excerpt("text", F.lit("license")).alias("excerpt"))


@query("""WITH l AS (SELECT doc_id, i, line, (contains(lower(line), 'license'))::INT + (contains(lower(line), 'version'))::INT + (contains(lower(line), 'under'))::INT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r FROM l WHERE n > 0 AND trim(line) <> '') SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS focus FROM documents d LEFT JOIN (SELECT * FROM r WHERE r <= 3) r USING (doc_id) GROUP BY d.doc_id""")
def focus_sentences(spark, sf_dir):
    """The lines with most of the words, in their own order."""
    from parley.operators.ranking import focus_lines

    return focus_lines(table(spark, sf_dir, "documents"), "text", ["license", "version", "under"], 3, "doc_id")


@query("""WITH e AS (SELECT doc_id, source AS entity, text FROM documents), n AS (SELECT entity, count(*) AS n FROM e GROUP BY entity), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS r FROM e)
SELECT entity, any_value(n) AS n, list(left(text, 100) ORDER BY r) AS contexts FROM n JOIN r USING (entity) WHERE r <= 3 GROUP BY entity""")
def entity_table(spark, sf_dir):
    """frequency and first contexts of each entity."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "entity")
    return reports.entity_table(d, "entity", "text", "doc_id")


@query("""WITH d AS (SELECT lang, length(text) AS b, length(regexp_replace(text, '\\s+', '', 'g')) AS a FROM documents WHERE length(regexp_replace(text, '\\s+', '', 'g')) > 0)
SELECT lang, count(*) AS n, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after, round(avg(b / a), 2) AS avg_ratio, round(max(b / a), 2) AS max_ratio, round(min(b / a), 2) AS min_ratio, round((1 - sum(a) / sum(b)) * 100, 1) AS saved_percent FROM d GROUP BY lang""")
def compression_report(spark, sf_dir):
    """sizes and ratios by language."""
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("b"), F.length(F.regexp_replace("text", "\\s+", "")).alias("a"))
    return reports.compression(d, "b", "a", ["lang"])


@query("""SELECT doc_id, CASE WHEN length(trim(text, ' ')) > 60 THEN rtrim(left(trim(text, ' '), 59), ' ') || '…' ELSE trim(text, ' ') END AS short FROM documents""")
def ellipsis(spark, sf_dir):
    """Texts cut to 60 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", X.ellipsis("text", 60).alias("short"))


@query("""SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '([a-z0-9]{2,})', 1))) AS tokens FROM benchmark""")
def tokenise(spark, sf_dir):
    """Distinct tokens."""
    return table(spark, sf_dir, "benchmark").select("item_id", X.tokens("text").alias("tokens"))


@query("SELECT doc_id, n_chars, CASE WHEN n_chars >= 1073741824 THEN printf('%.2f', round(n_chars / 1073741824, 2)) || ' GB' WHEN n_chars >= 1048576 THEN printf('%.2f', round(n_chars / 1048576, 2)) || ' MB' WHEN n_chars >= 1024 THEN printf('%.2f', round(n_chars / 1024, 2)) || ' KB' ELSE n_chars || ' B' END AS size FROM documents")
def format_size(spark, sf_dir):
    """Sizes for readers."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", X.format_size("n_chars").alias("size"))


@query("""WITH n AS (SELECT unnest(['trash', 'idiot', 'scum']) AS name), p AS (SELECT doc_id, name, text, strpos(text, name) AS pos FROM documents, n WHERE contains(text, name)) SELECT doc_id, name, substr(text, greatest(pos - 20, 1), pos + length(name) + 20 - greatest(pos - 20, 1)) AS context FROM p""")
def name_leaks(spark, sf_dir):
    """Rows in which a name is left, with context."""
    return reports.leaks(table(spark, sf_dir, "documents"), "text", ["trash", "idiot", "scum"]).select("doc_id", "name", "context")


@query("""SELECT doc_id, lang, coalesce(nullif(source, ''), 'none') AS source, 'doc' AS kind, CASE WHEN n_chars < 500 THEN 'short' END AS length FROM documents""")
def field_mapping(spark, sf_dir):
    """Mapping with constants and defaults."""
    d = table(spark, sf_dir, "documents").withColumn("size", F.when(F.col("n_chars") < 500, "short"))
    return messages.apply_mapping(d, {"doc_id": "doc_id", "lang": "lang", "source": "source", "_default:none": "source", "_const:doc": "kind", "size": "length"}).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("""SELECT d.doc_id, d.lang, d.source, CASE d.lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END AS language FROM documents d""")
def map_codes(spark, sf_dir):
    """Codes by a map literal."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", messages.map_code("lang", {"en": "English", "de": "German"}, "other").alias("language"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents), f AS (SELECT doc_id, trim(w) AS w, min(i) AS i FROM w WHERE trim(w) <> '' GROUP BY doc_id, trim(w)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
SELECT doc_id, coalesce(l, []) AS merged FROM documents LEFT JOIN (SELECT doc_id, list(w ORDER BY i) AS l FROM r WHERE r <= 40 GROUP BY doc_id) USING (doc_id)""")
def merge_lists(spark, sf_dir):
    """Union of two overlapping lists in order, without repeats, forty at most."""
    d = table(spark, sf_dir, "documents").withColumn("w", F.split(F.coalesce("text", F.lit("")), " ")).withColumn("n", F.size("w"))
    third = F.floor(F.col("n") / 3).cast("int")
    d = d.select("doc_id", F.slice("w", F.lit(1), F.col("n") - third).alias("a"), F.slice("w", third + 1, F.col("n") - third).alias("b"))
    return d.select("doc_id", joins.merge_lists("a", "b", 40).alias("merged"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents), f AS (SELECT doc_id, left(w, 3) AS h, arg_min(w, i) AS w, min(i) AS i FROM w GROUP BY doc_id, left(w, 3)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
SELECT doc_id, list(w ORDER BY i) AS kept FROM r WHERE r <= 30 GROUP BY doc_id""")
def dedupe_prefix(spark, sf_dir):
    """Items without a repeated beginning."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return d.select("doc_id", joins.dedupe_by_prefix("w", 3, 30).alias("kept"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_check(spark, sf_dir):
    """Values that occur more than once."""
    return reports.duplicates(table(spark, sf_dir, "documents"), "text")


@query("""SELECT doc_id::VARCHAR AS id, lang AS category, '' AS domain, '' AS question, '' AS evidence_tier, '' AS risk_level, source, '' AS license, '' AS review_status, '' AS reviewed_by, '' AS review_date, '' AS evidence_note FROM documents""")
def ledger(spark, sf_dir):
    """Ledger columns, empty where missing."""
    from parley.sources.sinks import ledger as columns

    return columns(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), "source"))


@query(
    """WITH l AS (SELECT doc_id, contains(text, 'stupid') AS harmless, CASE WHEN contains(text, 'scum') OR regexp_matches(text, '(the|er) .{0,4}(loser|clown)') OR contains(text, 'moron') THEN 3
  WHEN contains(text, 'idiot') OR regexp_matches(text, '(the|er) .{0,4}(trash)') OR contains(text, 'vermin') AND regexp_matches(text, 'the |er ') THEN 2 WHEN contains(text, 'clown') THEN 1 ELSE 0 END AS n FROM documents)
SELECT doc_id, ['GREEN', 'YELLOW', 'ORANGE', 'RED'][n - (n >= 2 AND harmless)::INT + 1] AS level FROM l WHERE n IS NOT NULL"""
)
def crisis_levels(spark, sf_dir):
    """Tiers of words, of words and phrases about oneself, and harmless phrases."""
    level = privacy.crisis("text", {"RED": ["scum"], "ORANGE": ["idiot"], "YELLOW": ["clown"]}, {"RED": ["loser", "clown"], "ORANGE": ["trash"]}, ["the ", "er "], ["stupid"], phrases={"RED": [("moron", False)], "ORANGE": [("vermin", True)]})
    return table(spark, sf_dir, "documents").select("doc_id", level.alias("level"))


@query("SELECT doc_id, md5(replace(replace(text, 'trash', 'rubbish'), 'idiot', 'person')) AS digest, ((length(text) - length(replace(text, 'trash', ''))) / 5)::INT + ((length(text) - length(replace(text, 'idiot', ''))) / 5)::INT AS n FROM documents")
def literal_patches(spark, sf_dir):
    """Literal replacements and their number."""
    p = {"trash": "rubbish", "idiot": "person"}
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.patch("text", p)).alias("digest"), X.patch_count("text", p).alias("n"))


@query("SELECT doc_id, regexp_extract(text, '(\\d+)', 1) AS first_number, len(regexp_extract_all(text, '[A-Z][a-z]+'))::BIGINT AS capitalised FROM documents")
def regex_fields(spark, sf_dir):
    """First match and counts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", "(\\d+)", 1).alias("first_number"), F.regexp_count("text", F.lit("[A-Z][a-z]+")).cast("long").alias("capitalised"))


@query("""SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{3,}')[1] AS first_match, regexp_extract_all(text, '[A-Z][a-z]{3,}')[-1] AS last_match FROM documents""")
def first_last_in_chunk(spark, sf_dir):
    """First and last match of a text."""
    from parley.operators.timeline import first_and_last_match

    first, last = first_and_last_match("text", "[A-Z][a-z]{3,}")
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("first_match"), last.alias("last_match"))


@query("""SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, 1) = 1 AND NOT coalesce(toxic = 1, false) AND length(text) BETWEEN 100 AND 5000""")
def metadata_filter(spark, sf_dir):
    """Conjunction of predicates before anything else."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    return d.where(F.length("text").between(100, 5000)).join(l, "doc_id", "left").where("coalesce(quality, 1) = 1 and not coalesce(toxic = 1, false)").select("doc_id", "lang", "quality", "toxic")
