"""Queries over single fields and rows: message columns, media rules, names, formats, model outputs, file readers.

Where the supplied tables lack a kind of value (file heads, Han text, marks of a model), it is derived from a key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import dates, text, times
from parley.operators import chunks, fusion, inference, joins, links, media, messages, privacy, reports, retrieval, review, scoring, timeline
from parley.plans.catalogue import query
from parley.plans.knowledge import _CHUNKS, _ENTRIES, _chunks, _entries
from parley.plans.tables import EVENT_ROWS, TURNS, event_rows, shared_folder, table, turns
from parley.sources import datasets, files, sinks


def pick(values: list, key):
    """The value in turn of an integer key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) if isinstance(key, str) else key).cast("int") % len(values) + 1)


def sql_pick(values: list, key: str) -> str:
    return "[" + ", ".join(repr(v) for v in values) + f"][({key}) % {len(values)} + 1]"


@query(f"WITH {TURNS} SELECT msg_uid, ts, speaker, NULL::INT AS type, 'text' AS modality, text_raw, (-1)::INT AS seq_in_html, '' AS \"MsgSvrID\", '' AS token, 0::INT AS sub_type FROM turns")
def canonical_columns(spark, sf_dir):
    """Canonical messages with their defaults."""
    return messages.canonical(turns(spark, sf_dir)).select("msg_uid", "ts", "speaker", "type", "modality", "text_raw", "seq_in_html", "MsgSvrID", "token", "sub_type")


@query(f"WITH {TURNS} SELECT msg_uid, ts, speaker, 'text' AS modality, 1::BIGINT AS type, 0::BIGINT AS sub_type, text_raw, '' AS time_local, '' AS token, seq, 'merged_v2' AS schema_version FROM turns")
def header_defaults(spark, sf_dir):
    """Header columns with defaults for what is missing."""
    return links.header(turns(spark, sf_dir)).select("msg_uid", "ts", "speaker", "modality", "type", "sub_type", "text_raw", "time_local", "token", "seq", "schema_version")


@query("SELECT turn AS ts, role AS speaker, text, conv_id FROM conversations")
def reordered_columns(spark, sf_dir):
    """Old names read as new ones, header first."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "text", F.col("turn").alias("timestamp"), F.col("role").alias("sender"))
    return messages.reorder(rows, ["ts", "speaker"], ["text"])


@query("SELECT conv_id, turn, role AS speaker, text AS text_raw, 'merged_v2' AS schema_version FROM conversations")
def migrated_columns(spark, sf_dir):
    """Columns renamed to the current schema; a second run changes nothing."""
    renames = {"text": "text_raw", "role": "speaker"}
    return messages.migrate(messages.migrate(table(spark, sf_dir, "conversations"), renames), renames)


_MODES = ["text", "image", "sticker", "voice"]


@query(
    f"""WITH {TURNS}, r AS (SELECT *, {sql_pick(_MODES, 'seq')} AS modality, left(text_raw, 20) AS s, CASE WHEN seq % 8 = 2 THEN left(text_raw, 20) ELSE 'hello' END AS i FROM turns)
SELECT msg_uid, speaker, modality, CASE WHEN modality = 'text' THEN nullif(text_raw, '') END AS text_raw,
  CASE WHEN modality = 'image' OR modality = 'sticker' AND s <> i THEN nullif(s, '') END AS summary, CASE WHEN modality = 'image' AND NOT (coalesce(s, '') <> '' AND length(text_raw) > 200) THEN nullif(text_raw, '') END AS ocr_text,
  CASE WHEN modality = 'sticker' THEN nullif(i, '') END AS intent, CASE WHEN modality = 'voice' THEN nullif(text_raw, '') END AS voice_to_text FROM r"""
)
def training_fields(spark, sf_dir):
    """The fields that each modality keeps for training."""
    t = turns(spark, sf_dir).select("msg_uid", "speaker", "seq", "text_raw").withColumn("modality", pick(_MODES, "seq")).withColumn("summary", F.left("text_raw", F.lit(20)))
    rows = t.withColumn("ocr_text", F.col("text_raw")).withColumn("intent", F.when(F.col("seq") % 8 == 2, F.col("summary")).otherwise("hello")).withColumn("voice_to_text", F.col("text_raw"))
    return messages.trim_for_training(rows).select("msg_uid", "speaker", "modality", "text_raw", "summary", "ocr_text", "intent", "voice_to_text")


_KINDS = ["text", "image", "voice", "video", "sticker", "location", "contact", "system", "link_or_file", "other"]


@query(
    f"SELECT page_id, CASE WHEN m = 'link_or_file' THEN CASE WHEN page_id // 10 % 3 = 1 THEN 'file' ELSE 'link' END WHEN m = 'other' THEN 'text' ELSE m END AS code FROM (SELECT page_id, {sql_pick(_KINDS, 'page_id')} AS m FROM pages)"
)
def message_codes(spark, sf_dir):
    """Type codes of messages by modality and sub type."""
    rows = table(spark, sf_dir, "pages").withColumn("m", pick(_KINDS, "page_id")).withColumn("s", pick([5, 6, 57], F.floor(F.col("page_id") / 10)))
    return rows.select("page_id", links.message_code("m", "s").alias("code"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand, CASE WHEN p_size % 3 = 0 THEN [p_type] END AS types, p_size % 2 = 0 AS even, 0::INT AS zero FROM part")
def blanks_to_null(spark, sf_dir):
    """C11: empty strings and lists become null, zero and false stay."""
    p = table(spark, sf_dir, "part")
    types = F.when(F.col("p_size") % 3 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    return messages.blank_to_null(p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("brand"), types.alias("types"), (F.col("p_size") % 2 == 0).alias("even"), F.lit(0).alias("zero")))


@query("SELECT p_partkey, p_name FROM part")
def columns_without_prefix(spark, sf_dir):
    """Columns of a prefix dropped."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit(1).alias("tmp_a"), F.lit(2).alias("tmp_b"))
    return messages.drop_prefixed(p, "tmp_")


_PATHS = ["raw/file/", "raw/x/", "raw/image/", "y/raw/"]


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'x/' || p_name ELSE {sql_pick(_PATHS, 'p_partkey')} || p_name END AS path FROM part")
def media_paths(spark, sf_dir):
    """C14: paths without a folder that no media folder follows."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(pick(_PATHS, "p_partkey"), "p_name").alias("path")).select("p_partkey", links.media_path("path").alias("path"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'own' || page_id WHEN 1 THEN 'wx' || page_id WHEN 2 THEN 'zz' || page_id END AS app_id FROM pages")
def app_ids(spark, sf_dir):
    """Mini-program ids from the field, the XML or the address."""
    n, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.when(n == 0, F.concat(F.lit("own"), i)).otherwise(" ").alias("field"), F.when(n == 1, F.concat(F.lit("<x><appid>wx"), i, F.lit("</appid>"))).alias("xml"),
        F.when(n == 2, F.concat(F.lit("http://a/?b=1&appid=zz"), i, F.lit("&c=2"))).otherwise("http://a/").alias("address"),
    )
    return p.select("page_id", links.app_id("xml", "address", "field").alias("app_id"))


_SUBS, _SUB_NAMES = [5, 6, 19, 33, 51, 57, 99], ["link", "file", "forward", "miniprogram", "channel", "quote", "unknown"]
_LINK_SQL = " ".join(f"WHEN {' OR '.join(f'contains(lower(url), {p!r})' for p in parts)} THEN {kind!r}" for kind, parts in media.LINK_TYPES.items())


@query(
    f"""WITH p AS (SELECT page_id, url, {sql_pick(_SUB_NAMES, 'page_id')} AS k, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE '' END AS title FROM pages)
SELECT 'P:' || page_id AS msg_uid, k AS link_sub_type, CASE WHEN k IN ('link', 'channel', 'forward') THEN title END AS link_title, CASE WHEN k = 'link' THEN url END AS link_url,
  CASE WHEN k = 'link' THEN CASE {_LINK_SQL} ELSE 'web' END END AS link_type, CASE WHEN k = 'file' THEN CASE WHEN title = '' THEN 'a' || page_id || '.pdf' ELSE title END END AS file_name,
  CASE WHEN k = 'file' THEN CASE WHEN title = '' THEN 'document' ELSE 'other' END END AS file_category, CASE WHEN k = 'miniprogram' THEN 'wx' || page_id END AS miniprogram_appid, CASE WHEN k = 'quote' THEN 'reply ' || page_id END AS quote_reply FROM p"""
)
def link_fields(spark, sf_dir):
    """Links and files by sub type with the fields of their kind."""
    i = F.col("page_id").cast("string")
    rows = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("P:"), i).alias("msg_uid"), pick(_SUBS, "page_id").alias("sub_type"), F.concat(F.lit("reply "), i).alias("text_raw"), F.col("url").alias("link_url"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("T"), i)).otherwise("").alias("link_title"), F.concat(F.lit("raw/file/a"), i, F.lit(".pdf")).alias("media_path"), F.concat(F.lit("wx"), i).alias("appid"),
    )
    return links.extract(rows).drop("media_path", "file_size")


@query("SELECT page_id, k AS link_sub_type, t AS link_title, f AS file_name FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'link' ELSE 'file' END AS k, CASE WHEN page_id % 2 = 0 THEN url END AS t, CASE WHEN page_id % 2 = 1 THEN 'a.pdf' END AS f FROM pages)")
def timeline_columns(spark, sf_dir):
    """The columns of links and files that go to a timeline, empty ones as null."""
    even = F.col("page_id") % 2 == 0
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("msg_uid"), F.when(even, "link").otherwise("file").alias("link_sub_type"), F.when(even, F.col("url")).otherwise("").alias("link_title"), F.when(~even, "a.pdf").otherwise("").alias("file_name"), F.lit("x").alias("link_url")
    )
    return links.timeline_fields(rows, slim=True).withColumnRenamed("msg_uid", "page_id")


@query("SELECT conv_id, turn, turn % 3 <> 1 AS recalled, CASE WHEN turn % 3 <> 1 THEN 'ME recalled a message' ELSE text END AS shown FROM conversations")
def recall_notices(spark, sf_dir):
    """Recall notices, shown with the role only."""
    notice = F.when(F.col("turn") % 3 == 0, "Ann Recalled a message").when(F.col("turn") % 3 == 2, "对方撤回了一条消息").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").withColumn("t", notice).select("conv_id", "turn", privacy.is_recall("t").alias("recalled"), privacy.anonymise_recall("t", F.lit("ME")).alias("shown"))


_TYPES = ["sticker", "image", "voice", "video", "location", "text", "time_gap"]


@query(
    f"""WITH r AS (SELECT conv_id, {sql_pick(_TYPES, 'turn + conv_id')} AS t FROM conversations), g AS (SELECT conv_id, {', '.join(f"count(*) FILTER (t = '{t}') AS {t}" for t in _TYPES[:5])}, count(*) FILTER (t <> 'time_gap') AS total_messages FROM r GROUP BY conv_id)
SELECT *, {' + '.join(_TYPES[:5])} AS total_multimodal, round(({' + '.join(_TYPES[:5])}) / greatest(total_messages, 1), 3) AS density FROM g"""
)
def chunk_density(spark, sf_dir):
    """Modalities of a chunk and their share."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", pick(_TYPES, F.col("turn") + F.col("conv_id")).alias("type"))
    return chunks.density(rows, ["conv_id"])


@query("SELECT doc_id, n_chars / 1000.0::DOUBLE * CASE WHEN contains(coalesce(text, ''), 'the ') THEN 1.2 ELSE 1.0 END AS score FROM documents")
def boosted_scores(spark, sf_dir):
    """Scores of texts with a wanted word raised."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars") / 1000).alias("score"))
    return retrieval.boost(rows, "text", ["the "]).select("doc_id", "score")


@query(f"WITH {_CHUNKS} SELECT chunk_id, 'recent' AS spec FROM c WHERE list_max(days) >= 30 UNION ALL SELECT chunk_id, 'day_7' FROM c WHERE list_contains(days, 7) UNION ALL SELECT chunk_id, 'days_3-4' FROM c WHERE list_contains(days, 3) OR list_contains(days, 4)")
def time_filters(spark, sf_dir):
    """Chunks of the recent days, of a day, of a range of days."""
    c, out = _chunks(spark, sf_dir), None
    for spec in ("recent", "day_7", "days_3-4"):
        one = retrieval.time_filter(c, spec, 60).select("chunk_id", F.lit(spec).alias("spec"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_ENTRIES} SELECT id FROM e")
def searchable_entries(spark, sf_dir):
    """Approved entries that are not for crises."""
    return retrieval.searchable(_entries(spark, sf_dir)).select("id")


@query(
    """SELECT item_id::VARCHAR AS id, list_filter([CASE WHEN item_id % 3 = 0 THEN 'missing:answer' END, CASE WHEN item_id % 4 = 0 THEN 'category' END, CASE WHEN item_id % 5 = 0 THEN 'evidence_tier' END,
  CASE WHEN contains(text, 'erth') THEN 'wording' END, CASE WHEN item_id % 7 = 0 THEN 'license' END], lambda x: x IS NOT NULL) AS problems FROM benchmark"""
)
def entry_problems(spark, sf_dir):
    """What is wrong with knowledge entries."""
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(
        i.cast("string").alias("id"), F.col("text").alias("question"), F.when(i % 3 == 0, "").otherwise("a").alias("answer"), F.when(i % 4 == 0, "odd").otherwise("theory").alias("category"),
        F.when(i % 5 == 0, "Z").otherwise("A").alias("evidence_tier"), F.when(i % 7 == 0, "All rights reserved").otherwise("MIT").alias("license"),
    )
    return datasets.knowledge_problems(rows, ["theory"], ["A", "B"], "erth")


_HEADS = {"jpeg": "FFD8FFE0", "png": "89504E470D0A1A0A", "gif": "47494638", "webp": "524946460000000057454250", "bmp": "424D", "mp4": "0000001866747970", "unknown": "00"}


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 8 = 7 THEN 'unknown' ELSE {sql_pick([*_HEADS, 'x'], 'p_partkey')} END AS format FROM part")
def file_formats(spark, sf_dir):
    """Formats by the first bytes; files too short are unknown."""
    heads = [h.ljust(40, "0") for h in _HEADS.values()] + ["FFD8FF"]
    return table(spark, sf_dir, "part").select("p_partkey", F.unhex(pick(heads, "p_partkey")).alias("b")).select("p_partkey", media.magic("b").alias("format"))


@query("SELECT p_partkey, CASE WHEN s > 0 AND s < 10240 THEN 'SKIP' WHEN d < 1 THEN 'SKIP' WHEN d < 3 THEN 'SINGLE_FRAME' WHEN least(w, h) <= 240 THEN 'LITE' ELSE 'FULL' END AS video, CASE WHEN s > 0 AND s < 1024 THEN 'SKIP' WHEN greatest(w, h) < 32 THEN 'SKIP' WHEN greatest(w, h) < 64 THEN 'LITE' WHEN d > 100 THEN 'LITE' ELSE 'FULL' END AS sticker FROM (SELECT p_partkey, p_size * 10 AS w, p_size * 7 AS h, p_partkey % 120 AS d, p_partkey * 97 % 20000 AS s FROM part)")
def media_tiers(spark, sf_dir):
    """How videos and stickers are worked on, by size and length."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10).alias("w"), (F.col("p_size") * 7).alias("h"), (F.col("p_partkey") % 120).alias("d"), (F.col("p_partkey") * 97 % 20000).alias("s"))
    return p.select("p_partkey", media.video_tier("w", "h", "d", "s").alias("video"), media.sticker_tier("w", "h", "s", "d").alias("sticker"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN false END AS processed, CASE WHEN p_size % 2 = 0 THEN 'skipped: ' || p_brand END AS description FROM part")
def skip_markers(spark, sf_dir):
    """Markers of what was skipped, with the reason."""
    p = table(spark, sf_dir, "part").select("p_partkey", links.skip_marker(F.when(F.col("p_size") % 2 == 0, "SKIP").otherwise("FULL"), "p_brand").alias("m"))
    return p.select("p_partkey", "m.processed", "m.description")


@query("SELECT p_partkey, CASE WHEN p_size / 50.0 > 0.85 THEN 'DOC' WHEN p_partkey % 10 / 10.0 > 0.5 AND p_size % 2 = 0 THEN 'GORE' WHEN p_partkey % 10 / 10.0 > 0.5 THEN 'NSFW' ELSE 'NORMAL' END AS kind FROM part")
def content_types(spark, sf_dir):
    """Kinds of images by scores and words."""
    p = table(spark, sf_dir, "part")
    text_share = F.when(F.col("p_size") / 50 > 0.85, 0.9).otherwise(0.1)
    return p.withColumn("t", text_share).withColumn("n", F.col("p_partkey") % 10 / 10).withColumn("s", F.lit(0.0)).select("p_partkey", media.content_type("n", "s", "t", F.col("p_size") % 2 == 0).alias("kind"))


@query(
    """SELECT conv_id, turn, list_concat(list_concat(CASE WHEN turn % 2 = 0 THEN ['emotion:ANGRY'] ELSE [] END, CASE WHEN turn % 3 = 0 THEN ['event:CRY'] ELSE [] END),
  list_filter([CASE WHEN contains(text, 'erth') THEN 'a:erth' END, CASE WHEN contains(text, 'onen') THEN 'b:onen' END], lambda x: x IS NOT NULL)) AS reasons FROM conversations"""
)
def triage(spark, sf_dir):
    """Reasons to look at a row: emotions, events, words."""
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("e", F.when(F.col("turn") % 2 == 0, F.array(F.lit("ANGRY"), F.lit("HAPPY"))).otherwise(F.array(F.lit("HAPPY")))).withColumn("v", F.when(F.col("turn") % 3 == 0, F.array(F.lit("CRY"))))
    return c.select("conv_id", "turn", media.triage_reasons("e", "v", "text", {"a": ["erth"], "b": ["onen"]}, ["ANGRY"], ["CRY"]).alias("reasons"))


@query("SELECT conv_id, turn, CASE WHEN length(trim(coalesce(left(text, turn * 3), ''))) >= 10 THEN left(text, turn * 3) ELSE 'second' END AS caption FROM conversations")
def caption_choice(spark, sf_dir):
    """The second caption where the first is too short."""
    c = table(spark, sf_dir, "conversations").withColumn("a", F.left("text", (F.col("turn") * 3).cast("int"))).withColumn("b", F.lit("second"))
    return c.select("conv_id", "turn", inference.coalesce_captions("a", "b").alias("caption"))


@query("WITH q AS (SELECT conv_id, arg_max(text, turn) AS t, max(turn) AS y FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id) SELECT 'CV:' || c.conv_id AS msg_uid, coalesce(q.t, 'own') AS quote_text, coalesce(q.y, -1) AS quote_type FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN q USING (conv_id)")
def quoted_texts(spark, sf_dir):
    """Quotes with the text and type of what they quote, their own as fallback."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id").distinct().select(F.concat(F.lit("CV:"), "conv_id").alias("msg_uid"), F.lit("own").alias("quote_text"), F.lit(-1).cast("long").alias("quote_type"))
    lookup = c.where("conv_id % 2 = 0").select(F.col("conv_id").cast("string").alias("svr_id"), F.col("text").alias("quote_text"), F.col("turn").alias("quote_type"), F.col("turn").alias("seq"))
    return links.quotes(rows, lookup)


@query("SELECT page_id, p_name, p_partkey IS NOT NULL AS matched FROM pages LEFT JOIN part ON p_partkey = page_id AND page_id % 2 = 0")
def file_name_join(spark, sf_dir):
    """A join on the number in a file's name."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("img/"), "page_id", F.lit(".jpg"))).otherwise("none.txt").alias("path"))
    side = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("number"), "p_name")
    return links.by_file_name(rows, side, "path", "([0-9]+)\\.jpg$", "number").select("page_id", "p_name", "matched")


@query("WITH u AS (SELECT o_custkey AS k, max(o_totalprice) AS b FROM orders GROUP BY 1) SELECT c_custkey, c_name, CASE WHEN u.k IS NULL THEN c_acctbal ELSE greatest(c_acctbal, u.b) END AS c_acctbal, u.k IS NOT NULL AS updated FROM customer LEFT JOIN u ON u.k = c_custkey")
def merged_upsert(spark, sf_dir):
    """An upsert with the caller's own rule for a column."""
    updates = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return joins.upsert(target, updates, "c_custkey", {"c_acctbal": F.greatest("t.c_acctbal", "u.c_acctbal")})


@query("SELECT c_custkey, n.n_name AS nation_n_name, n.n_nationkey IS NOT NULL AS has_nation, r.r_name AS region_r_name, r.r_regionkey IS NOT NULL AS has_region FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN region r ON r.r_regionkey = c_nationkey")
def enriched_rows(spark, sf_dir):
    """Several sides on one key, each with its prefix and a mark of a match."""
    sides = {"nation": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "region": table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name")}
    return joins.enrich(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), "k", sides).drop("k")


_BEFORE, _AFTER = ["气死了", "在吗?", "今天 天气", "好!!"], ["嗯", "哦哦哦", "昨天 吃饭"]


@query(
    """SELECT conv_id, turn, CASE WHEN h >= 12 AND b IN (0, 3) THEN 'conflict_cooling' WHEN h >= 4 AND (a = 0 OR b = 1) THEN 'potential_cold_shoulder' WHEN b = 2 AND a = 2 THEN 'topic_change' ELSE 'normal_gap' END AS kind
FROM (SELECT conv_id, turn, turn * 2 AS h, conv_id % 4 AS b, turn % 3 AS a FROM conversations)"""
)
def gap_kinds(spark, sf_dir):
    """Kinds of gaps by the words on both sides."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", pick(_BEFORE, "conv_id").alias("b"), pick(_AFTER, "turn").alias("a"), (F.col("turn") * 7200).alias("s"))
    return c.select("conv_id", "turn", timeline.gap_kind_by_keywords("b", "a", "s", ["气死"], ["嗯"]).alias("kind"))


@query(
    """WITH r AS (SELECT user_id AS conv_id, event_id AS seq, epoch_us(ts) // 1000000 AS ts, event_type AS speaker, value < 120 AS is_cold FROM events),
w AS (SELECT *, ts - lag(ts) OVER (PARTITION BY conv_id ORDER BY ts, seq) AS delay, list(CASE WHEN is_cold THEN speaker END) OVER (PARTITION BY conv_id ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS ahead FROM r)
SELECT conv_id, seq, delay, len(list_filter(coalesce(ahead, []), lambda x: x = speaker)) AS cold FROM w WHERE delay > 3600 AND is_cold AND len(list_filter(coalesce(ahead, []), lambda x: x = speaker)) >= 2"""
)
def cold_answers(spark, sf_dir):
    """Late and cold answers that are followed by more of them."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("seq"), times.epoch("ts").alias("ts"), F.col("event_type").alias("speaker"), F.when(F.col("value") < 120, "ok").otherwise("a longer text").alias("text_raw"))
    return timeline.cold_rows(rows, ["ok"], delay=3600, least=2).select("conv_id", "seq", "delay", "cold")


@query("SELECT p_partkey, list_transform(range(0, least(5, p_size)), lambda i: (i * p_size // least(5, p_size))::INT) AS frames FROM part")
def frame_picks(spark, sf_dir):
    """Frames spread evenly."""
    return table(spark, sf_dir, "part").select("p_partkey", media.even_stride("p_size", 5).alias("frames"))


@query(
    """WITH s AS (SELECT p_partkey, p_size % 10 AS s1, p_size % 10 + p_partkey % 7 + 1 AS e1, p_size % 5 + 3 AS s2, p_size % 5 + 7 AS e2 FROM part),
o AS (SELECT p_partkey, CASE WHEN f THEN s1 ELSE s2 END AS s1, CASE WHEN f THEN e1 ELSE e2 END AS e1, CASE WHEN f THEN s2 ELSE s1 END AS s2, CASE WHEN f THEN e2 ELSE e1 END AS e2 FROM (SELECT *, s1 < s2 OR s1 = s2 AND e1 > e2 AS f FROM s))
SELECT p_partkey, CASE WHEN s2 >= e1 THEN [s1, s2] WHEN e2 - s2 > e1 - s1 THEN [s2] ELSE [s1] END AS starts, CASE WHEN s2 >= e1 THEN [e1, e2] WHEN e2 - s2 > e1 - s1 THEN [e2] ELSE [e1] END AS ends FROM o"""
)
def resolved_spans(spark, sf_dir):
    """Overlapping spans resolved, the longer one stays."""
    span = lambda s, e, c: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(c).alias("confidence"))
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(span(size % 10, size % 10 + F.col("p_partkey") % 7 + 1, 0.5), span(size % 5 + 3, size % 5 + 7, 0.9)).alias("spans"))
    kept = rows.select("p_partkey", joins.resolve_spans("spans").alias("k"))
    return kept.select("p_partkey", F.transform("k", lambda x: x["start"]).alias("starts"), F.transform("k", lambda x: x["end"]).alias("ends"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN [p_brand, 'x'] ELSE [p_brand, 'x', 'y'] END AS tags, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_type || ' / other' END AS note,
  CASE WHEN p_size % 2 = 0 THEN 'high' WHEN p_size % 3 = 0 THEN 'low' ELSE 'medium' END AS risk, CASE WHEN p_size % 3 = 0 THEN 'rule' ELSE 'rule+model' END AS merged_from FROM part"""
)
def merged_analyses(spark, sf_dir):
    """One analysis from several: lists united, texts appended, the largest risk."""
    make = lambda tags, note, risk: F.struct(F.array(*tags).alias("tags"), note.alias("note"), risk.alias("risk"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", make([F.col("p_brand"), F.lit("x")], F.col("p_type"), F.when(F.col("p_size") % 2 == 0, "high").otherwise("low")).alias("a"),
        F.when(F.col("p_size") % 3 != 0, make([F.lit("x"), F.lit(" y ")], F.lit("other"), F.lit("medium"))).alias("b"),
    )
    return fusion.merge_analyses(rows, {"rule": "a", "model": "b"}, ["tags"], ["note"], "risk")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id WHEN 1 THEN page_id + 1 END AS a FROM pages")
def model_answers(spark, sf_dir):
    """The JSON of model outputs, fenced, bare or missing."""
    i = F.col("page_id")
    out = F.when(i % 3 == 0, F.format_string('so:\n```json\n{"a": %d}\n```', i)).when(i % 3 == 1, F.format_string('<think>{"a": 0}</think> it is {"a": %d} I think', i + 1)).otherwise("no idea")
    return table(spark, sf_dir, "pages").select("page_id", out.alias("o")).select("page_id", inference.parse("o", "a long").alias("p")).select("page_id", "p.a")


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS at FROM orders")
def parsed_times(spark, sf_dir):
    """Times in any of the known formats."""
    n = len(times.FORMATS)
    shown = F.coalesce(*[F.when(F.col("o_orderkey") % n == i, F.date_format("o_orderdate", f)) for i, f in enumerate(times.FORMATS)])
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("t")).select("o_orderkey", times.epoch(times.parse("t")).alias("at"))


@query("SELECT p_partkey, strftime(DATE '2025-06-07' + p_size - 1, '%Y-%m-%d') || ' and ' || strftime(DATE '2025-06-07' + p_size * 11 - 1, '%Y-%m-%d') AS text, 2 AS n FROM part")
def day_references(spark, sf_dir):
    """References to days as dates."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.format_string("第%d天 and 第%d天", "p_size", F.col("p_size") * 11).alias("t"))
    return rows.select("p_partkey", dates.days_to_dates("t", "2025-06-07").alias("text"), dates.day_reference_count("t").alias("n"))


@query("""SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN list_transform(range(turn + 1, turn + 4), lambda d: d::INT) WHEN 1 THEN [(conv_id % 20 + 1)::INT] ELSE list_transform(range(9 + turn % 5, 12 + turn % 5), lambda d: d::INT) END AS days FROM conversations""")
def question_days(spark, sf_dir):
    """The days that a question before a turn's text names: a range of days, a day, or a range of dates of June."""
    import datetime

    days, day, dated = F.concat(F.lit("第"), F.col("turn") + 1, F.lit("天到第"), F.col("turn") + 3, F.lit("天")), F.concat(F.lit("第"), F.col("conv_id") % 20 + 1, F.lit("天")), F.concat(F.lit("6月"), 16 + F.col("turn") % 5, F.lit("日到"), 18 + F.col("turn") % 5, F.lit("日"))
    asked = F.concat(F.when(F.col("conv_id") % 3 == 0, days).when(F.col("conv_id") % 3 == 1, day).otherwise(dated), F.lit("? "), F.regexp_replace("text", "\\d", ""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", dates.query_days_of(asked, datetime.date(2025, 6, 8), 60).alias("days"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'ME' ELSE 'OTHER:' || role END AS speaker FROM conversations")
def speakers(spark, sf_dir):
    """Roles of participants, others by name."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", messages.speaker_of("role", {"user": "ME"}).alias("speaker"))


@query("SELECT conv_id, turn, array_to_string(list_filter(ws, lambda w, i: list_position(list_transform(ws, lambda x: lower(x)), lower(w)) = i), ' ') AS words FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS ws FROM conversations)")
def words_in_order(spark, sf_dir):
    """Words without later repeats, in any case."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.distinct_words("text", ignore_case=True).alias("words"))


@query("SELECT conv_id, turn, '## A\n' || text || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || '## B' || chr(10) || role ELSE '' END AS context FROM conversations WHERE text <> ''")
def context_sections(spark, sf_dir):
    """Titled sections, empty ones left out."""
    c = table(spark, sf_dir, "conversations").where("text <> ''")
    return c.select("conv_id", "turn", retrieval.context({"A": F.col("text"), "B": F.when(F.col("turn") % 2 == 0, F.col("role"))}).alias("context"))


@query("SELECT p_partkey, concat_ws(' | ', p_brand || ', ' || p_type, CASE WHEN p_size % 2 = 0 THEN left(p_name, 5) END, CASE WHEN p_size % 3 = 0 THEN 'calm' END) AS line FROM part")
def summary_lines(spark, sf_dir):
    """Topics, cause and emotion in a line."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", retrieval.summary(F.array("p_brand", "p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.when(F.col("p_size") % 3 == 0, "calm"), 5).alias("line"))


@query(f"WITH {TURNS} SELECT msg_uid, CASE WHEN conv_id % 5 = 0 THEN 'never' ELSE strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') END AS shown FROM turns")
def shown_times(spark, sf_dir):
    """Times shown by a pattern, missing ones by a word."""
    t = turns(spark, sf_dir).withColumn("at", F.when(F.col("conv_id") % 5 == 0, F.lit(0)).otherwise(F.col("ts")))
    return t.select("msg_uid", times.format_epoch("at", "yyyy-MM-dd HH:mm:ss", "never").alias("shown"))


@query("SELECT p_partkey, 'Bob met Ann at ' || p_name || ', I and ME_TOO' AS text, ['Ann'] AS contents FROM part")
def restored_names(spark, sf_dir):
    """Pseudonyms back to names, in texts and messages."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("[PERSON_10] met [PERSON_1] at "), "p_name", F.lit(", ME and ME_TOO")).alias("t"), F.array(F.struct(F.lit("user").alias("role"), F.lit("[PERSON_1]").alias("content"))).alias("m"))
    names, roles = {"[PERSON_1]": "Ann", "[PERSON_10]": "Bob"}, {"ME": "I"}
    return p.select("p_partkey", fusion.restore(F.col("t"), names, roles).alias("text"), F.transform(fusion.restore_messages("m", names, roles), lambda m: m["content"]).alias("contents"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['你好', '天气'] ELSE ['天气'] END AS runs FROM part")
def han_run_lists(spark, sf_dir):
    """Distinct runs of Han characters."""
    t = F.concat(F.when(F.col("p_size") % 2 == 0, "你好 ").otherwise("好 "), F.lit("天气, "), "p_name", F.lit(" 天气"))
    return table(spark, sf_dir, "part").select("p_partkey", text.han_runs(t, 2).alias("runs"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(text, 'then', 'Y', 'gi'), 'the', 'X', 'gi') AS text FROM conversations")
def names_replaced(spark, sf_dir):
    """Names by their replacement, longer ones first, in any case."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", privacy.replace_names("text", {"the": "X", "then": "Y"}, ignore_case=True).alias("text"))


@query("SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '王小明' ELSE '李四' END AS candidate FROM conversations WHERE conv_id % 3 < 2")
def name_finds(spark, sf_dir):
    """Candidates for names, known words left out."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", pick(["我见 王小明 了", "李四 说", "高兴 王小明天见面了"], "conv_id").alias("t")).withColumn("k", F.struct("conv_id", "turn"))
    return privacy.name_candidates(c, "k", "t", ["王", "李", "高"], ["高兴"]).select("k.conv_id", "k.turn", "candidate")


@query("SELECT conv_id, turn, CASE WHEN contains(text, 'erth') THEN 'HIGH' WHEN contains(text, 'onen') OR contains(text, 'tion') THEN 'LOW' ELSE 'NONE' END AS risk FROM conversations")
def risk_levels(spark, sf_dir):
    """The first tier of which a word occurs."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", privacy.risk_level("text", {"HIGH": ["erth"], "LOW": ["onen", "tion"]}).alias("risk"))


@query("SELECT p_partkey, '  1. ' || p_brand || chr(10) || '  2. calm day' AS lines, CASE WHEN contains(p_type, 'STANDARD') THEN 'see someone' ELSE replace(p_type, 'ECONOMY', 'cheap') END AS guarded FROM part")
def safe_texts(spark, sf_dir):
    """Numbered items with softer terms, banned texts by a notice."""
    p = table(spark, sf_dir, "part").withColumn("i", F.array(F.col("p_brand"), F.lit("bad day")))
    return p.select("p_partkey", fusion.numbered("i", {"bad": "calm"}).alias("lines"), fusion.guard("p_type", ["STANDARD"], {"ECONOMY": "cheap"}, "see someone").alias("guarded"))


@query(
    """SELECT conv_id, turn, (least(length(t) / 500.0::DOUBLE, 1.0) + least(length(left(t, 50)) / 300.0::DOUBLE, 1.0) + (contains(t, 'the')::INT + contains(t, 'and')::INT) / 2.0::DOUBLE
  + least(len(string_split(t, chr(10))) / 10.0::DOUBLE, 1.0) + CASE WHEN regexp_matches(lower(t), 'i cannot|i can''t|unable to') THEN 0.0 ELSE 1.0 END) / 5 AS quality FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)"""
)
def answer_quality(spark, sf_dir):
    """Quality of answers from five parts."""
    c = table(spark, sf_dir, "conversations").withColumn("think", F.left("text", F.lit(50)))
    return c.select("conv_id", "turn", chunks.quality("text", "think", ["the", "and"]).alias("quality"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'ask' WHEN contains(text, 'erth') THEN 'x' WHEN contains(text, 'the') THEN 'y' ELSE 'other' END AS intent, CASE WHEN role = 'system' THEN 0.95 WHEN contains(text, 'erth') THEN 0.8 WHEN contains(text, 'the') THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM conversations")
def sticker_intents(spark, sf_dir):
    """Intents by the text on a sticker, then by its caption."""
    out = scoring.sticker_intent("text", "role", {"ask": ["system"]}, [(0.8, {"x": ["erth"]}), (0.5, {"y": ["the"]})])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("o")).select("conv_id", "turn", "o.intent", "o.confidence")


_ANALYSES = ["听起来很开心，语速较快，笑声不断，像是在分享好消息", "语气很平静，没有什么特别的起伏，像是在陈述事实而已", "短", "这段话没有任何词" * 8]


@query("SELECT p_partkey, p_partkey % 4 IN (0, 3) AS kept FROM part")
def analyses_kept(spark, sf_dir):
    """Analyses that say something."""
    return table(spark, sf_dir, "part").select("p_partkey", scoring.analysis_worth_keeping(pick(_ANALYSES, "p_partkey")).alias("kept"))


@query(f"WITH {TURNS} SELECT msg_uid, CASE WHEN d <= 3 THEN 1 / (1 + d) END AS score FROM (SELECT msg_uid, abs(floor((1700864000 - ts) / 86400.0::DOUBLE)) AS d FROM turns)")
def fuzzy_days(spark, sf_dir):
    """Scores by nearness to a day."""
    t = turns(spark, sf_dir).withColumn("target", F.lit(1700864000).cast("long"))
    return t.select("msg_uid", times.fuzzy_day_score("ts", "target", 3).cast("double").alias("score"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['HAPPY', 'BGM'] ELSE ['SAD'] END AS tags, p_name AS text FROM part")
def speech_tags(spark, sf_dir):
    """The marks of a speech model, and the text without them."""
    t = F.concat(F.when(F.col("p_size") % 2 == 0, "<|HAPPY|><|BGM|>").otherwise("<|SAD|>"), F.col("p_name"))
    return table(spark, sf_dir, "part").withColumn("t", t).select("p_partkey", inference.tags("t").alias("tags"), inference.without_tags("t").alias("text"))


@query("SELECT p_partkey, greatest(p_size, 20) AS a, greatest(p_partkey % 10, 3) AS b, list_filter([CASE WHEN p_size > 40 THEN 0 END, NULL], lambda x: x IS NOT NULL)::INT[] AS frames FROM part")
def frame_scores(spark, sf_dir):
    """The largest scores over frames, and the frames above a trigger."""
    frame = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    p = table(spark, sf_dir, "part").withColumn("s", F.array(frame(F.col("p_size"), F.lit(3)), frame(F.lit(20), F.col("p_partkey") % 10)))
    return p.select("p_partkey", inference.frame_maxima("s", ["a", "b"], {"a": 40}).alias("m")).select("p_partkey", "m.a", "m.b", "m.frames")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size / 100.0::DOUBLE WHEN 1 THEN 0.5 END AS confidence FROM part WHERE p_size > 1")
def confidences(spark, sf_dir):
    """Q08: confidence that a model states, in percent or as a share."""
    t = F.when(F.col("p_partkey") % 3 == 0, F.format_string("Yes. Confidence: %d%%", "p_size")).when(F.col("p_partkey") % 3 == 1, "confidence = 0.5").otherwise("sure")
    return table(spark, sf_dir, "part").where("p_size > 1").withColumn("t", t).select("p_partkey", inference.confidence("t").alias("confidence"))


@query("SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM orders")
def dimension_counts(spark, sf_dir):
    """counts by several columns and in all, in one scan."""
    return reports.counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderstatus, count(*) AS n, avg((o_orderpriority = '1-URGENT')::INT) AS urgent, max(o_totalprice) AS dearest FROM orders GROUP BY 1")
def order_kpis(spark, sf_dir):
    """named measures by group."""
    measures = {"n": F.count("*"), "urgent": F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")), "dearest": F.max("o_totalprice")}
    return reports.kpis(table(spark, sf_dir, "orders"), ["o_orderstatus"], measures)


@query("SELECT p_brand, count(*) AS n, sum(p_partkey + 100)::BIGINT AS before, sum(p_size)::BIGINT AS after FROM part WHERE p_size > 0 GROUP BY 1")
def saved_sizes(spark, sf_dir):
    """sizes before and after, by group."""
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") + 100).alias("b"), F.col("p_size").alias("a"))
    return reports.compression(p, "b", "a", ["p_brand"]).select("p_brand", "n", "before", "after")


@query(
    f"""WITH {TURNS} SELECT seq::VARCHAR AS "localId", CASE WHEN speaker = 'ME' THEN '1' ELSE '2' END AS "TalkerId", (speaker = 'ME')::INT AS "IsSender", ts AS "CreateTime", text_raw AS "StrContent",
  strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS "StrTime", speaker AS "Sender" FROM turns"""
)
def exported_rows(spark, sf_dir):
    """Rows of a message export."""
    t = turns(spark, sf_dir).withColumn("local_id", F.lit(None).cast("string")).withColumn("type", F.lit(1)).withColumn("sub_type", F.lit(0))
    return sinks.export_rows(t).select("localId", "TalkerId", "IsSender", "CreateTime", "StrContent", "StrTime", "Sender")


@query(
    f"""WITH {TURNS}, l AS (SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS date, ts, seq, '**' || strftime(make_timestamp(ts * 1000000), '%H:%M:%S') || ' ' || speaker || '**: ' || coalesce(text_raw, '') AS line FROM turns)
SELECT date, '## ' || date || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY ts, seq, line) AS body FROM l GROUP BY date"""
)
def markdown_bodies(spark, sf_dir):
    """A page of Markdown per day."""
    return sinks.markdown_days(turns(spark, sf_dir))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'image/2023-11/a.png' ELSE 'voice/a.png' END AS target FROM conversations")
def media_targets(spark, sf_dir):
    """Where media go, by kind and month."""
    c = table(spark, sf_dir, "conversations").withColumn("m", F.when(F.col("turn") % 2 == 0, "image").otherwise("voice")).withColumn("ts", F.lit(1700000000)).withColumn("name", F.lit("a.png"))
    return c.select("conv_id", "turn", sinks.media_target("m", "ts", "name").alias("target"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def lines_read_back(spark, sf_dir):
    """Rows written as JSON lines and read again."""
    path = shared_folder(spark, "jsonl")
    sinks.jsonl(table(spark, sf_dir, "conversations"), path)
    return files.jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT conv_id * 1000 + turn AS ts, CASE role WHEN 'user' THEN 'ME' ELSE role END AS speaker, nullif(text, '') AS text_raw, 'text' AS modality FROM conversations")
def csv_read_back(spark, sf_dir):
    """Rows written as CSV and read by a field mapping."""
    path = shared_folder(spark, "csv")
    c = table(spark, sf_dir, "conversations")
    sinks.csv(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("when"), F.col("role").alias("who"), F.col("text").alias("what")), path)
    mapping = {"when": "ts", "who": "speaker", "what": "text_raw", "_const:text": "modality"}
    return files.reader("csv")(spark, path, mapping, "CSV", {"user": "ME"}).select("ts", "speaker", "text_raw", "modality")


@query(f"WITH {TURNS} SELECT ts // 60 * 60 AS ts, speaker, text_raw, 'text' AS modality FROM turns WHERE text_raw <> ''")
def chat_read_back(spark, sf_dir):
    """Messages written as a chat export, with years of four digits, and read again."""
    path = shared_folder(spark, "chat")
    t = turns(spark, sf_dir).where("text_raw <> ''")
    t.select(F.concat(F.date_format(F.timestamp_seconds("ts"), "M/d/yyyy, h:mm a"), F.lit(" - "), "speaker", F.lit(": "), "text_raw").alias("value")).write.text(path)
    return files.chat_text(spark, path, {"ME": "ME", "OTHER": "OTHER", "SYSTEM": "SYSTEM"}).select("ts", "speaker", "text_raw", "modality")


@query("WITH l AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'ME: ' ELSE 'OTHER: ' END || coalesce(text, ''), chr(10) ORDER BY turn) AS c FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id) SELECT 'set' AS source, c AS conversation FROM l")
def dialogues_read_back(spark, sf_dir):
    """Dialogues of a training set as conversations."""
    path = shared_folder(spark, "dialogues")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))  # turns of one conversation
    sinks.jsonl(rows.select("messages"), path)
    return datasets.dialogues(spark, path, "set")


@query("SELECT item_id::VARCHAR AS id, text AS question, [left(text, 3)] AS keywords FROM benchmark")
def knowledge_read_back(spark, sf_dir):
    """Knowledge entries of JSON lines below a folder."""
    path = shared_folder(spark, "knowledge")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.array(F.left("text", F.lit(3))).alias("keywords"))
    b.write.json(path + "/a.jsonl")
    out = spark.read.schema(datasets.KNOWLEDGE).option("recursiveFileLookup", True).json(path)
    return out.select("id", "question", "keywords")


@query("SELECT 'J:' || (3 * row_number() OVER (ORDER BY conv_id, turn) - 2) AS msg_uid, conv_id * 1000 + turn AS ts, CASE role WHEN 'user' THEN 'ME' ELSE 'OTHER:' || role END AS speaker, nullif(text, '') AS text_raw FROM conversations")
def mapped_lines_read_back(spark, sf_dir):
    """JSON lines by a field mapping, each followed by a line that is no JSON, an array and a blank one."""
    path = shared_folder(spark, "mapped")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("when"), F.col("role").alias("who"), F.col("text").alias("what"))).alias("j"))
    c.orderBy("conv_id", "turn").coalesce(1).select(F.concat("j", F.lit("\n{bad\n[1]\n   ")).alias("value")).write.text(path)
    return files.mapped_jsonl(spark, path, {"when": "ts", "who": "speaker", "what": "text_raw"}, "J", {"user": "ME"}).select("msg_uid", "ts", "speaker", "text_raw")


def _review(spark, sf_dir):
    """Analysed conversations: documents with their labels."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    decision = F.when(F.col("doc_id") % 5 == 0, "approve").when(F.col("doc_id") % 5 == 1, "reject")
    return d.join(l, "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("conversation"), (F.col("quality") == 1).alias("passed"), decision.alias("human_decision"), F.concat("lang", F.lit(" from "), "source").alias("analysis"), F.array("lang", "source").alias("suggestions"), (F.col("doc_id") % 3 == 0).alias("reviewed"))


_REVIEW = "r AS (SELECT doc_id AS id, text AS conversation, quality = 1 AS passed, CASE doc_id % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END AS human_decision, lang || ' from ' || source AS analysis, [lang, source] AS suggestions, doc_id % 3 = 0 AS reviewed FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_REVIEW} SELECT id, left(coalesce(conversation, ''), 200) AS preview FROM r WHERE NOT passed AND human_decision IS DISTINCT FROM 'approve'")
def review_failed(spark, sf_dir):
    """Items that neither the model nor a human passed."""
    return review.review_items(_review(spark, sf_dir), "failed").select("id", "preview")


@query(f"WITH {_REVIEW} SELECT count(*) AS total, count(*) FILTER (passed) AS ai_passed, count(*) FILTER (NOT passed) AS ai_failed, count(*) FILTER (human_decision = 'approve') AS human_approved, count(*) FILTER (human_decision = 'reject') AS human_rejected, count(*) FILTER (human_decision IS NULL) AS pending FROM r")
def review_counts(spark, sf_dir):
    """Items by state."""
    return review.review_counts(_review(spark, sf_dir))


@query(f"WITH {_REVIEW} SELECT id::VARCHAR AS id, md5(conversation) AS conversation, analysis, suggestions, reviewed FROM r")
def review_round_trip(spark, sf_dir):
    """Pages for review written as Markdown and read again."""
    pages = _review(spark, sf_dir).select(review.to_markdown("id", "conversation", "analysis", "suggestions", "reviewed").alias("page"))
    return pages.select(review.from_markdown("page").alias("r")).select("r.*").withColumn("conversation", F.md5("conversation"))


@query(f"WITH {_REVIEW} SELECT 'You help.' || chr(10) || chr(10) || 'Say what this is.' AS instruction, md5(conversation) AS input, analysis AS output FROM r WHERE reviewed")
def training_alpaca(spark, sf_dir):
    """Reviewed samples as records of instruction, input and output."""
    return review.training_records(_review(spark, sf_dir), "You help.", "Say what this is.", "alpaca", only_reviewed=True).withColumn("input", F.md5("input"))


@query(f"WITH {_REVIEW} SELECT 3 AS n, 'system user assistant' AS roles, md5('Say what this is.' || chr(10) || chr(10) || conversation || analysis) AS digest FROM r")
def training_chat(spark, sf_dir):
    """Samples as chats of three messages."""
    m = review.training_records(_review(spark, sf_dir), "You help.", "Say what this is.").select("messages")
    return m.select(F.size("messages").alias("n"), F.array_join("messages.role", " ").alias("roles"), F.md5(F.concat(F.col("messages")[1]["content"], F.col("messages")[2]["content"])).alias("digest"))


@query("SELECT 'c' || conv_id AS conversation_id, text AS conversation_text, '' AS timestamp, 'c' || conv_id AS chunk, role, turn::VARCHAR AS turn FROM conversations")
def chunk_rows(spark, sf_dir):
    """Chunks under common names, the rest as a map."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("chunk_id"), F.col("text").alias("conversation"), "role", "turn")
    return review.chunk_rows(c).select("conversation_id", "conversation_text", "timestamp", F.col("metadata")["chunk_id"].alias("chunk"), F.col("metadata")["role"].alias("role"), F.col("metadata")["turn"].alias("turn"))


@query("SELECT event_id FROM events WHERE event_id % 7 = 0 OR strftime(ts, '%Y-%m-%dT%H:%M:%S') >= strftime((SELECT max(ts) FROM events) - INTERVAL 3 DAY, '%Y-%m-%dT%H:%M:%S')")
def recent_or_undated(spark, sf_dir):
    """Rows of the last days, and those without a time."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts")).first()[0]
    at = F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return review.within_days(e.select("event_id", at.alias("at")), "at", F.lit(now), 3).select("event_id")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_results(spark, sf_dir):
    """The latest result of each user."""
    return review.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "value")


@query(f"WITH {EVENT_ROWS} SELECT conv_id, event_day, list_sort(list(DISTINCT speaker)) AS agents, count(*) AS events, sum(length(text_raw))::BIGINT AS chars, min(ts) AS first, max(ts) AS last, max(ts) - min(ts) AS seconds FROM (SELECT *, ts // 86400 AS event_day FROM ev) GROUP BY conv_id, event_day")
def round_summaries(spark, sf_dir):
    """events of a session by round."""
    e = event_rows(spark, sf_dir).withColumn("event_day", F.floor(F.col("ts") / 86400))
    return review.rounds(e, ["conv_id", "event_day"], "ts", "speaker", "text_raw")


@query("SELECT item_id FROM benchmark ORDER BY md5('7|' || item_id), item_id LIMIT 5")
def quality_sample(spark, sf_dir):
    """A sample for a look at the quality, the same for a seed."""
    return review.quality_sample(table(spark, sf_dir, "benchmark"), "item_id", 5, 7).select("item_id")


@query("SELECT page_id, url FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 2 AND starts_with(url, 'http')")
def sticker_rows(spark, sf_dir):
    """Sticker messages with their addresses."""
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("raw/"), "url")).when(F.col("page_id") % 3 == 2, F.lit("no address"))
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "sticker").otherwise("text").alias("modality"), F.lit(47).alias("type"), raw.alias("text_raw"), F.when(F.col("page_id") % 3 == 1, F.col("url")).alias("media_path"))
    return review.stickers(p).select("page_id", "url")


@query("SELECT s_name AS name FROM supplier ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN 99 ELSE s_suppkey % 11 END, s_name LIMIT 3")
def hotline_list(spark, sf_dir):
    """The first lines by priority."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 11).alias("priority"))
    return review.hotlines(s).select("name")


@query("SELECT l_orderkey, count(*) >= 3 AND count(*) FILTER (l_quantity > 1.2 * l_linenumber * 5) / count(*) > 0.6 AS turned FROM lineitem GROUP BY l_orderkey")
def turned_pictures(spark, sf_dir):
    """Pictures whose text boxes stand upright; a box is as high as a quantity and five times as wide as a number."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = F.array(point(F.lit(2), F.lit(1)), point(2 + 5 * F.col("l_linenumber"), F.lit(1)), point(F.lit(2), 1 + F.col("l_quantity")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes")).select("l_orderkey", review.turned("boxes").alias("turned"))
