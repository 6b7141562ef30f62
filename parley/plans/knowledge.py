"""Queries of retrieval over chunks and entries, rule scores, sessions and generated sources."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from parley.functions import dates, text
from parley.functions.times import epoch
from parley.operators import chunks, inference, joins, ranking, reports, retrieval, scoring, timeline
from parley.plans.catalogue import query
from parley.plans.messages import LABELS
from parley.plans.tables import table
from parley.sources import datasets


def _chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("chunk_"), F.lpad((F.col("conv_id") * 100 + F.col("turn")).cast("string"), 6, "0")).alias("chunk_id"), "text", F.array((F.col("conv_id") % 60 + 1).cast("int"), (F.col("conv_id") % 60 + 1 + F.col("turn") % 2).cast("int")).alias("days"), F.col("role").alias("type"),
    )


_CHUNKS = "c AS (SELECT 'chunk_' || lpad((conv_id * 100 + turn)::VARCHAR, 6, '0') AS chunk_id, text, [conv_id % 60 + 1, conv_id % 60 + 1 + turn % 2] AS days, role AS type FROM conversations)"


@query(f"WITH {_CHUNKS} SELECT chunk_id, list_min(list_filter(days, lambda d: d IN (5, 9, 10)))::INT AS first_day FROM c WHERE len(list_filter(days, lambda d: d IN (5, 9, 10))) > 0")
def day_lookup(spark, sf_dir):
    """Chunks of the days of a question."""
    days = dates.query_days("第5天 and 第9-10天", datetime.date(2025, 6, 8), 60)
    return retrieval.by_days(_chunks(spark, sf_dir), sorted({*days, 5})).select("chunk_id", "first_day")


@query(f"WITH {_CHUNKS} SELECT chunk_id FROM c WHERE len(list_filter(days, lambda d: d BETWEEN 20 AND 25)) > 0 AND type = 'user'")
def day_range_type(spark, sf_dir):
    """Chunks of a range of days and a type."""
    return retrieval.by_type(retrieval.time_filter(_chunks(spark, sf_dir), "days_20-25", 60), "user").select("chunk_id")


_SHARE = "(contains(text, 'the')::INT + contains(text, 'and')::INT + contains(text, 'ing')::INT + contains(text, 'que')::INT) / 4.0::DOUBLE"


@query(f"""WITH {_CHUNKS}, s AS (SELECT chunk_id, list_max(list_filter(days, lambda d: d BETWEEN 10 AND 30)) AS day, {_SHARE} AS sim FROM c WHERE len(list_filter(days, lambda d: d BETWEEN 10 AND 30)) > 0), n AS (SELECT * FROM s ORDER BY sim DESC, chunk_id LIMIT 30)
SELECT chunk_id, 0.7::DOUBLE * sim + 0.3::DOUBLE / (1 + 0.1::DOUBLE * (30 - day)) AS score FROM n ORDER BY score DESC, chunk_id LIMIT 15""")
def day_range_hybrid(spark, sf_dir):
    """Chunks of a range of days by similarity and nearness to its end."""
    share = sum(F.contains("text", F.lit(w)).cast("int") for w in ("the", "and", "ing", "que")) / 4.0
    return retrieval.search_days(_chunks(spark, sf_dir), 10, 30, "hybrid", share, 15).select("chunk_id", "score")


_ASK = "list_sort(list_distinct(regexp_extract_all(lower({0}), '([a-z0-9]{{2,}})', 1)))"


@query(f"""WITH {_CHUNKS}, q AS (SELECT item_id, CASE WHEN contains(text, 'tion') THEN 'why' WHEN contains(text, 'the') THEN 'what' ELSE '' END AS intent, {_ASK.format('text')} AS w FROM benchmark),
x AS (SELECT item_id, intent, list_distinct(list_concat(w, CASE WHEN list_contains(w, 'the') THEN ['der'] ELSE [] END)) AS w, CASE intent WHEN 'why' THEN 3 WHEN 'what' THEN 2 ELSE 1 END AS k, intent = 'why' AS rerank, CASE WHEN intent = 'what' THEN 'and' END AS need FROM q),
t AS (SELECT item_id, unnest(w) AS t FROM x), d AS (SELECT chunk_id, unnest({_ASK.format('text')}) AS t FROM c), h AS (SELECT item_id, chunk_id, count(*)::DOUBLE AS score FROM t JOIN d USING (t) GROUP BY ALL),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 20),
s AS (SELECT f.item_id, x.intent, f.chunk_id, x.k, CASE WHEN x.rerank THEN len(list_filter(x.w, lambda v: contains(lower(c.text), v)))::DOUBLE / len(x.w) ELSE f.score END AS score FROM f JOIN x USING (item_id) JOIN c USING (chunk_id) WHERE x.need IS NULL OR contains(lower(c.text), x.need))
SELECT item_id AS question_id, intent, chunk_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id))::INT AS rank FROM s QUALIFY rank <= k""")
def smart_search(spark, sf_dir):
    """Intent, strategy, rewriting, search, reranking and filters for a table of questions."""
    chunks_ = _chunks(spark, sf_dir).withColumn("tokens", text.tokens("text"))
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    strategies = {"why": {"k": 3, "rerank": True}, "what": {"k": 2, "rerank": False, "need": "and"}, "": {"k": 1}}
    return retrieval.smart_search(questions, chunks_, {"why": ["tion"], "what": ["the"]}, strategies, {"the": "der"})


@query(f"WITH {_CHUNKS}, d AS (SELECT unnest(days) AS day, chunk_id, left(text, 100) AS p FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY chunk_id) AS r, count(*) OVER (PARTITION BY day) AS n FROM d) SELECT day::INT AS day, any_value(n) AS n, list(p ORDER BY r) AS previews FROM r WHERE r <= 5 GROUP BY day")
def day_timeline(spark, sf_dir):
    """Chunks by day with previews."""
    return retrieval.day_timeline(_chunks(spark, sf_dir))


def _entries(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.lit("").alias("answer"), F.when(F.col("item_id") % 3 == 0, "theory").otherwise("practice").alias("category"),
        F.slice(F.split("text", " "), 1, 3).alias("keywords"), F.when(F.col("item_id") % 5 == 0, "draft").otherwise("approved").alias("review_status"), F.when(F.col("item_id") % 7 == 0, "crisis").alias("risk_level"),
    )


_ENTRIES = "e AS (SELECT item_id::VARCHAR AS id, lower(text || ' ') AS t, CASE WHEN item_id % 3 = 0 THEN 'theory' ELSE 'practice' END AS category, list_transform(string_split(text, ' ')[1:3], lambda x: lower(x)) AS k FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 7 <> 0)"
_WORDS = ["the", "that", "erth", "onen", "is"]
_LEX = "(" + " + ".join(f"contains(t, '{w}')::INT + 2 * list_contains(k, '{w}')::INT" for w in _WORDS) + ") * CASE WHEN category = 'theory' THEN 2 ELSE 1 END"


@query(f"WITH {_ENTRIES} SELECT id, ({_LEX})::DOUBLE AS score FROM e WHERE {_LEX} > 0")
def faq_lexical(spark, sf_dir):
    """Points by words, keywords and category, of searchable entries."""
    return retrieval.lexical(_entries(spark, sf_dir), _WORDS, "theory")


@query(f"""WITH {_ENTRIES}, l AS (SELECT id, row_number() OVER (ORDER BY {_LEX} DESC, id) AS rank FROM e WHERE {_LEX} > 0), m AS (SELECT id, (id::INT * 37 % 101) / 100 AS s FROM e), s AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM m WHERE s >= 0.3),
u AS (SELECT * FROM l UNION ALL SELECT * FROM s) SELECT id, sum(1 / (60 + rank)) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 5""")
def faq_hybrid(spark, sf_dir):
    """Fusion of lexical and semantic ranks above a floor."""
    similarity = (F.col("id").cast("int") * 37 % 101) / 100
    return retrieval.hybrid(_entries(spark, sf_dir), _WORDS, similarity, 5, 0.3, "theory")


@query(f"""WITH {_ENTRIES}, r AS (SELECT id, category AS k, row_number() OVER (PARTITION BY category ORDER BY id) AS rank FROM e), t AS (SELECT * FROM r WHERE k = 'theory' AND rank = 1), h AS (SELECT k, count(*) AS n FROM t GROUP BY k),
f AS (SELECT r.id, r.k, r.rank, row_number() OVER (PARTITION BY r.k ORDER BY r.rank, r.id) AS q, coalesce(h.n, 0) AS n FROM r LEFT JOIN h ON h.k = r.k WHERE r.id NOT IN (SELECT id FROM t)) SELECT k, id, rank::INT AS rank FROM f WHERE q <= 2 - n""")
def perspective_floor(spark, sf_dir):
    """Topping up categories to two entries."""
    ranked = ranking.rank_in(retrieval.searchable(_entries(spark, sf_dir)).select("id", F.col("category").alias("k"), F.lit(0).alias("z")), ["k"], "z", "id")
    taken = ranked.where("k = 'theory' and rank = 1").select("id", "k")
    return ranking.fill_quota(ranked, taken, "id", 2, "have", ["k"]).select("k", "id", "rank")


@query("""WITH s AS (SELECT vec_id, (vec_id * 7919 % 1009)::DOUBLE AS a, (vec_id * 104729 % 997)::DOUBLE AS b FROM embeddings), r AS (SELECT * FROM s ORDER BY a DESC, vec_id LIMIT 20) SELECT vec_id, b AS rerank FROM r ORDER BY b DESC, vec_id LIMIT 5""")
def two_stage_rank(spark, sf_dir):
    """A dear score for the best of a cheap one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 7919 % 1009).cast("double").alias("a"))
    return retrieval.rerank(e, "a", (F.col("vec_id") * 104729 % 997).cast("double"), 20, 5, "vec_id").select("vec_id", "rerank")


@query()
def cell_search(spark, sf_dir):
    """Nearest vectors in the probed cells; recall is checked in the tests."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    indexed, centres = retrieval.index_cells(e, 16)
    return retrieval.search_cells(indexed, centres, list(e.where("vec_id = 0").first().embedding), 6, 10, "vec_id")


@query("""WITH p AS (SELECT a.vec_id AS x, unnest([0, 1]) AS l, CASE WHEN unnest([0, 1]) = 0 THEN a.vec_id % 40 ELSE a.vec_id END AS id, a.vec_id + 1 AS rank FROM embeddings a), m AS (SELECT id, min(l) AS l FROM p GROUP BY id), n AS (SELECT p.id, m.l AS list, min(rank) AS rank FROM p JOIN m ON p.id = m.id AND p.l = m.l GROUP BY ALL) SELECT id, list::INT AS list, rank FROM n ORDER BY list, rank, id LIMIT 8""")
def priority_hits(spark, sf_dir):
    """Hits of one list before those of another, each once."""
    e = table(spark, sf_dir, "embeddings")
    first = e.select((F.col("vec_id") % 40).alias("id"), (F.col("vec_id") + 1).alias("rank"))
    second = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") + 1).alias("rank"))
    return ranking.priority_union(first, second, "id", 8)


@query("""SELECT conv_id, turn, least(CASE WHEN length(text) > 3000 THEN 0.3 WHEN length(text) > 1000 THEN 0.15 ELSE 0 END + least((contains(text, 'the')::INT + contains(text, 'nicht')::INT + contains(text, 'que')::INT) * 0.05, 0.3) + CASE role WHEN 'assistant' THEN 0 ELSE 0 END, 1) AS score FROM conversations""")
def task_complexity(spark, sf_dir):
    """Points of a task."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scoring.complexity("text", "role", ["the", "nicht", "que"]).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'long_context' WHEN o_orderkey % 10 = 0 THEN 'fallback' WHEN o_custkey % 100 / 100 <= 0.3 THEN 'local' WHEN o_custkey % 100 / 100 <= 0.7 THEN 'local_thinking' ELSE 'cloud' END AS backend FROM orders")
def model_route(spark, sf_dir):
    """Backend by context, budget and score."""
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.route(F.col("o_custkey") % 100 / 100, F.col("o_totalprice"), F.col("o_orderkey") % 10 == 0, long=400000).alias("backend"))


@query("""SELECT event_id, value <= 40 AS trigger_hit, event_type = 'error' AS crisis_block, user_id % 7 < 2 AS cooldown_block, event_id % 9 < 3 AS min_turn_block, value <= 40 AND event_type <> 'error' AND user_id % 7 >= 2 AND event_id % 9 >= 3 AS eligible FROM events""")
def eligibility(spark, sf_dir):
    """Whether a point is eligible and why not."""
    e = table(spark, sf_dir, "events").withColumn("since", F.col("user_id") % 7).withColumn("turn", F.col("event_id") % 9)
    return e.select("event_id", scoring.eligibility("value", "event_type", "since", "turn", 40, ["error"], 3, 2).alias("e")).select("event_id", "e.*")


@query("SELECT doc_id, CASE WHEN quality + toxic * 2 >= 3 THEN 'positive' ELSE 'negative' END AS screening, CASE WHEN quality >= toxic AND quality >= 0 THEN 'quality' ELSE 'toxic' END AS dominant FROM labels")
def questionnaire(spark, sf_dir):
    """Thresholds and the dominant answer."""
    return table(spark, sf_dir, "labels").select("doc_id", scoring.screening(F.col("quality") + F.col("toxic") * 2).alias("screening"), scoring.dominant({"quality": "quality", "toxic": "toxic"}).alias("dominant"))


_STYLES = {"plain": ["the ", "der "], "linked": [" and ", " und ", " et "]}


@query(f"""WITH f AS (SELECT conv_id, CASE role WHEN 'user' THEN 'ME' ELSE 'OTHER' END AS side, max(contains(text, 'the ')::INT) + max(contains(text, 'der ')::INT) AS a, max(contains(text, ' and ')::INT) + max(contains(text, ' und ')::INT) + max(contains(text, ' et ')::INT) AS b,
{', '.join(f"max(({' OR '.join(f'contains(text, {chr(39)}{w}{chr(39)})' for w in ws)})::INT) AS d{i}" for i, ws in enumerate(LABELS.values()))} FROM conversations GROUP BY ALL)
SELECT conv_id, side, CASE WHEN a + b = 0 THEN 'none' WHEN a >= b THEN 'plain' ELSE 'linked' END AS style, list_filter([{', '.join(f"CASE WHEN d{i} = 1 THEN '{k}' END" for i, k in enumerate(LABELS))}], lambda x: x IS NOT NULL)[1:3] AS defences FROM f""")
def speaker_marks(spark, sf_dir):
    """Style and marks of each side."""
    c = table(spark, sf_dir, "conversations").withColumn("speaker", F.when(F.col("role") == "user", "ME").otherwise("OTHER"))
    return scoring.speaker_marks(c, ["conv_id"], "text", _STYLES, LABELS)


@query("""WITH v AS (SELECT user_id, least(0.3 * avg(value / 100) + 0.4 * quantile_cont(value / 100, 0.9) + 0.3 * avg((value / 100 > 0.5)::INT), 1) AS intensity FROM events GROUP BY user_id) SELECT user_id, round(intensity, 4) AS intensity FROM v""")
def motion_intensity(spark, sf_dir):
    """Intensity of motion scores."""
    return scoring.motion(table(spark, sf_dir, "events").withColumn("v", F.col("value") / 100), "user_id", "v").select("user_id", F.round("intensity", 4).alias("intensity"))


@query("""SELECT doc_id, CASE WHEN len(f) <= 5 THEN 'sequential' WHEN len(f) <= 10 THEN 'segmented' ELSE 'key_changes' END AS strategy FROM (SELECT doc_id, string_split(text, chr(10)) AS f FROM documents)""")
def merge_strategy(spark, sf_dir):
    """Strategy by number of frames."""
    return table(spark, sf_dir, "documents").select("doc_id", scoring.merge_strategy(F.split("text", "\n")).alias("strategy"))


@query("""WITH t AS (SELECT doc_id, trim(left(text, 400), ' ') AS c, trim(lang, ' ') AS o FROM documents), b AS (SELECT doc_id, CASE WHEN o = '' THEN c WHEN c = '' THEN left(o, 150) ELSE c || ' | ' || left(o, 60) END AS b FROM t)
SELECT doc_id, CASE WHEN length(b) <= 150 THEN b WHEN regexp_extract(left(b, 150), '(?s)^(.*[。.!！?？])', 1) <> '' THEN regexp_extract(left(b, 150), '(?s)^(.*[。.!！?？])', 1) ELSE left(b, 150) END AS summary FROM b""")
def image_summary(spark, sf_dir):
    """Caption and OCR text in at most 150 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(400)).alias("c"), "lang")
    return d.select("doc_id", scoring.image_summary("c", "lang").alias("summary"))


@query()
def frame_summary(spark, sf_dir):
    """Frames of a document's lines; folds are checked in the tests."""
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("f")).select("doc_id", scoring.frame_summary("f").alias("summary"))


@query(f"""WITH a AS (SELECT user_id AS id, min(epoch_us(ts) // 1000000) AS start FROM events GROUP BY user_id), m(i, minute, speaker, modality, text_raw) AS (VALUES {', '.join(f"({i}, {sum(x[0] for x in datasets.ARC[: i + 1])}, '{s}', '{k}', '{t}')" for i, (_, s, k, t) in enumerate(datasets.ARC))})
SELECT 'GEN:' || (id * {len(datasets.ARC)} + i) AS msg_uid, start + (id * 1440 + minute) * 60 AS ts, speaker, 1 AS type, modality, text_raw, id * {len(datasets.ARC)} + i AS seq FROM a CROSS JOIN m""")
def generated_messages(spark, sf_dir):
    """Messages by a template from each user's first event on."""
    return datasets.generated(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.min(epoch("ts")).alias("start")))


@query("""WITH g AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last_role, max(turn) AS m FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN n % 5 = 0 THEN 'crisis' WHEN last_role = 'assistant' THEN 'responded' ELSE 'in_progress' END AS status FROM g""")
def session_status(spark, sf_dir):
    """Status by the last round."""
    c = table(spark, sf_dir, "conversations")
    n = F.count("*")
    level = F.lit("")
    rows = c.groupBy("conv_id").agg(n.alias("n"), F.max_by("role", "turn").alias("last_role"))
    rounds = F.array(F.struct(F.when(F.col("n") % 5 == 0, "RED").otherwise(level).alias("level"), F.lit(None).cast("string").alias("vote"), (F.col("last_role") == "assistant").alias("responded")))
    return rows.withColumn("rounds", rounds).select("conv_id", chunks.resolve_status("rounds").alias("status"))


@query("""SELECT event_id, CASE WHEN t >= 44 THEN 'pass' WHEN t % 4 = 0 THEN 'fail' WHEN t >= 36 THEN 'pass' WHEN t >= 20 THEN 'needs_revision' ELSE 'fail' END AS verdict FROM (SELECT event_id, floor(value / 2)::INT AS t FROM events)""")
def verdicts(spark, sf_dir):
    """Verdict by points."""
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") / 2).cast("int").alias("t")).withColumn("said", F.when(F.col("t") % 4 == 0, "fail"))
    return e.select("event_id", chunks.verdict("t", "said").alias("verdict"))


@query("SELECT page_id, len(regexp_extract_all(html, '<([a-z0-9]+)', 1))::BIGINT AS tags, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_fields(spark, sf_dir):
    """Regex scans of pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).cast("long").alias("tags"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""WITH m AS (SELECT event_id, props::JSON->>'$.k' AS k, event_type FROM events) SELECT event_id, k::INT AS k, event_type = 'click' AND k::INT % 2 = 0 AS flag FROM m""")
def json_fields(spark, sf_dir):
    """Typed fields of semi-structured values."""
    e = table(spark, sf_dir, "events").withColumn("j", F.from_json("props", "k int"))
    return e.select("event_id", F.col("j.k").alias("k"), ((F.col("event_type") == "click") & (F.col("j.k") % 2 == 0)).alias("flag"))


@query("""SELECT lang, list_sort(list(DISTINCT source)) AS sources, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang""")
def chunk_stats(spark, sf_dir):
    """distributions by type."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'absent', 0""")
def data_stats(spark, sf_dir):
    """Rows by table."""
    from parley.plans.engine import Engine

    return Engine(spark).sizes({"documents": table(spark, sf_dir, "documents"), "pages": table(spark, sf_dir, "pages"), "absent": None})


@query("""WITH p AS (SELECT p_partkey, p_brand, sum(l_quantity) AS q FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY q DESC, p_partkey) AS rank FROM p) SELECT p_brand, p_partkey, q AS score, rank::INT AS rank FROM r WHERE rank <= 3""")
def top_per_group(spark, sf_dir):
    """The best three of each group."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("score"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(g, F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey")
    return ranking.rank_in(p, ["p_brand"], "score", "p_partkey", 3)


@query("""SELECT c.c_custkey, c.c_name, o.o_orderkey IS NOT NULL AS has_order, o.o_totalprice AS order_price, n.n_name IS NOT NULL AS has_nation, n.n_name AS nation_name FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)) o ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey < 12) n ON n.c_custkey = c.c_custkey""")
def enrich_sides(spark, sf_dir):
    """Sides joined on a key, their columns prefixed."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    last = joins.last_by_key(o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("price")), "c_custkey", "o_orderkey").select("c_custkey", "price")
    home = c.join(n.where("n_nationkey < 12"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"))
    return joins.enrich(c.select("c_custkey", "c_name"), "c_custkey", {"order": last, "nation": home}).select("c_custkey", "c_name", "has_order", "order_price", "has_nation", "nation_name")


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, count(*) OVER (PARTITION BY l_orderkey) AS n, coalesce(lead(l_quantity, 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - l_quantity, 0) AS change FROM lineitem""")
def frame_deltas(spark, sf_dir):
    """Changes to the next row within a group."""
    from pyspark.sql import Window as W

    l = table(spark, sf_dir, "lineitem").withColumn("n", F.count("*").over(W.partitionBy("l_orderkey")))  # noqa: E741
    out = timeline.later_change(l, "l_quantity", 1, "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "n", F.coalesce("delta", F.lit(0.0)).alias("change"))


def _counter():
    """A stand-in for a model: it counts letters and cannot read a text with an at sign."""

    def model(texts: list[str]) -> list[str]:
        if any("@" in t for t in texts):
            raise ValueError("no addresses")
        return [str(len(t)) for t in texts]

    return model


@query("SELECT doc_id, CASE WHEN contains(coalesce(text, ''), '@') THEN NULL ELSE length(coalesce(text, ''))::VARCHAR END AS output, CASE WHEN contains(coalesce(text, ''), '@') THEN 'ValueError: no addresses' END AS error FROM documents")
def model_shell(spark, sf_dir):
    """Batches through a caller's model; a batch that fails is halved until the texts that fail are known."""
    return inference.apply_model(table(spark, sf_dir, "documents"), "doc_id", "text", _counter)


@query("""SELECT 'a' AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT 'b', count(*), count(DISTINCT user_id) FROM events WHERE ts >= TIMESTAMP '2024-01-10'""")
def windowed_kpis(spark, sf_dir):
    """indicators before and after a date in one scan."""
    e = table(spark, sf_dir, "events").withColumn("k", F.when(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), "a").otherwise("b"))
    return reports.kpis(e, ["k"], {"n": F.count("*"), "users": F.count_distinct("user_id")})
