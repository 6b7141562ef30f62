"""Canonical messages: schema, validation, field mapping, headers, trimming by modality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import clean_unicode

# The canonical message.
MODALITIES = ["text", "image", "voice", "video", "sticker", "link_or_file", "location", "contact", "system"]
SPEAKERS = ["ME", "OTHER"]
REQUIRED = ["msg_uid", "ts", "speaker", "type", "modality", "text_raw"]
_COLUMNS = (
    "msg_uid string, ts bigint, speaker string, type int, modality string, text_raw string, seq_in_html int, MsgSvrID string, token string, time_local string, sub_type int, "
    "media_path string, voice_length int, voice_to_text string, link_url string, link_title string, miniprogram_appid string, quote_svrid string, quote_type int, quote_text string, "
    "file_name string, file_size string, location_x double, location_y double, location_label string, contact_nickname string, contact_username string"
)
_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}
CANONICAL = T.StructType([T.StructField(c.split()[0], _TYPES[c.split()[1]]) for c in _COLUMNS.split(", ")])
DEFAULTS = {"seq_in_html": -1, "MsgSvrID": "", "token": "", "time_local": "", "sub_type": 0}
#: Columns kept for training, by modality, beyond the core ones.
TRAINING_CORE = ["msg_uid", "speaker", "time_local", "modality"]
TRAINING_FIELDS = {
    "text": ["text_raw"], "image": ["summary", "ocr_text"], "voice": ["voice_to_text", "emotion_tags"], "video": ["summary"], "sticker": ["intent", "summary"],
    "link_or_file": ["link_title", "link_url", "file_name", "quote_text"], "location": ["location_label"], "contact": ["contact_nickname"], "system": ["text_raw"],
}


def canonical(df: DataFrame) -> DataFrame:
    """All columns of the canonical message in order, missing ones with their defaults; further columns are dropped."""
    have = set(df.columns)

    def column(f: T.StructField) -> Column:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        return (F.coalesce(c, F.lit(DEFAULTS[f.name]).cast(f.dataType)) if f.name in DEFAULTS else c).alias(f.name)

    return df.select(*[column(f) for f in CANONICAL])


def errors(columns: list[str]) -> Column:
    """Array of error codes of a message row, empty if it is valid."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) if c in columns else F.lit(f"missing:{c}") for c in REQUIRED]
    if "ts" in columns:
        checks.append(F.when(F.col("ts") <= 0, F.lit("ts")))
    if "modality" in columns:
        checks.append(F.when(~F.col("modality").isin(MODALITIES), F.lit("modality")))
    if "speaker" in columns:
        checks.append(F.when(~F.col("speaker").rlike(f"^({'|'.join(SPEAKERS)})(:|$)"), F.lit("speaker")))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def validate(df: DataFrame) -> DataFrame:
    """The rows with an array column `errors`."""
    return df.withColumn("errors", errors(df.columns))


def error_report(df: DataFrame) -> DataFrame:
    """(error, n): how often each error occurs."""
    return validate(df).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Target columns of a mapping `source: target`, `_const:value: target` or `_default:value: target`.

    Empty and null sources do not set a target, later entries win over earlier ones, defaults fill what is still unset.
    """
    found: dict[str, list[Column]] = {}
    default: dict[str, Column] = {}
    for source, target in mapping.items():
        if source.startswith("_const:"):
            found.setdefault(target, []).append(F.lit(source[7:]))
        elif source.startswith("_default:"):
            default.setdefault(target, F.lit(source[9:]))
        elif source in df.columns:
            text = F.col(f"`{source}`").cast("string")
            found.setdefault(target, []).append(F.when(text != "", text))
        else:
            found.setdefault(target, [])
    return df.select(*[F.coalesce(*reversed(found.get(t, [])), *([default[t]] if t in default else []), F.lit(None).cast("string")).alias(t) for t in dict.fromkeys([*found, *default])])


def mapping_errors(mapping: dict[str, str]) -> list[str]:
    """Required targets that a mapping lacks, sorted; msg_uid is made by the reader."""
    return sorted(set(REQUIRED) - {"msg_uid"} - set(mapping.values()))


def reorder(df: DataFrame, header: list[str], fields: list[str]) -> DataFrame:
    """Header columns, then fields, then all others; timestamp and sender are read as ts and speaker where these are missing."""
    for old, new in (("timestamp", "ts"), ("sender", "speaker")):
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    first = [c for c in [*header, *fields] if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def migrate(df: DataFrame, renames: dict[str, str], version: str = "merged_v2") -> DataFrame:
    """Columns renamed and schema_version set; rows of that version stay as they are, so that a second run changes nothing."""
    for old, new in renames.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    return df.withColumn("schema_version", F.lit(version))


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings and empty arrays become null; 0 and false stay."""
    out = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(c != "", c)
        elif isinstance(f.dataType, T.ArrayType):
            out[f.name] = F.when(F.size(c) > 0, c)
    return df.withColumns(out)


def trim_for_training(df: DataFrame, fields: dict[str, list[str]] = TRAINING_FIELDS, long_ocr: int = 200) -> DataFrame:
    """Only the columns that the row's modality keeps, cleaned, others null.

    An image's long OCR text goes when there is a summary; a sticker's summary goes when it repeats the intent.
    """
    columns = [c for c in dict.fromkeys([*TRAINING_CORE, *(c for f in fields.values() for c in f)]) if c in df.columns]
    out = []
    for c in columns:
        value = F.col(c)
        if c not in TRAINING_CORE:
            value = F.when(F.col("modality").isin([m for m, f in fields.items() if c in f]), value)
        if c == "ocr_text" and "summary" in columns:
            value = F.when(~((F.col("modality") == "image") & (F.coalesce("summary", F.lit("")) != "") & (F.length("ocr_text") > long_ocr)), value)
        if c == "summary" and "intent" in columns:
            value = F.when(~((F.col("modality") == "sticker") & (F.col("summary") == F.col("intent"))), value)
        out.append(value.alias(c))
    out = df.select(*out)
    return blank_to_null(out.withColumns({f.name: clean_unicode(f.name) for f in out.schema if isinstance(f.dataType, T.StringType)}))


def map_code(c: str, codes: dict, default: str | None = None) -> Column:
    """Lookup in a map literal."""
    pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.col(c)), F.lit(default))


def speaker_of(name: str, participants: dict[str, str]) -> Column:
    """Participant's role, else OTHER:name."""
    return F.coalesce(map_code(name, participants) if participants else F.lit(None), F.concat(F.lit("OTHER:"), F.col(name)))
