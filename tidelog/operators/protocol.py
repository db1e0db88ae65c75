"""The log as JSON lines, and as lines for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KINDS, PAYLOAD, SAMPLE_RATE, SEGMENT, TOLERANCE, WORD

VERSION = "1.0"
#: Payload fields of each kind; a speaker event names a word (target_seq) or a turn.
FIELDS = {
    "speech_onset": (),
    "turn_start": ("audio_start", "speaker", "turn"),
    "partial": ("audio_end", "audio_start", "text"),
    "commit": ("audio_end", "audio_start", "confidence", "delay", "emitted_at", "speaker", "text", "turn"),
    "speaker": ("audio_end", "audio_start", "speaker", "target_seq", "turn"),
    "endpoint": ("completeness", "reason", "turn"),
    "degraded": ("degraded", "lag"),
    "polished": ("from_seq", "text", "to_seq", "turn"),
}


def rounded(value: Column, kind: T.DataType) -> Column:
    """Every float in a value of any nesting rounded to 6 places."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.round(value, 6)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rounded(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: rounded(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(rounded(value[f.name], f.dataType).alias(f.name) for f in kind)))
    return value


def known_kind(kind: Column) -> Column:
    """The kind, or an error for one that the log doesn't have."""
    return F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("no such kind of event: "), F.coalesce(kind, F.lit("null")))))


def encode(log: DataFrame, *keep: str) -> DataFrame:
    """session_id, what is to be kept, and line: one JSON object an event, keys sorted, the fields of its kind only, floats
    rounded."""
    types = {f.name: f.dataType for f in log.schema}
    field = lambda n: rounded(F.col(n), types[n]).alias(n)
    line = F.lit(None).cast("string")
    for kind, names in FIELDS.items():
        payload = F.struct(*map(field, names)) if names else F.create_map().cast("map<string,string>")
        json = F.to_json(F.struct(field("at"), F.col("kind"), payload.alias("payload"), F.col("seq")), {"ignoreNullFields": "false"})
        line = F.when(F.col("kind") == kind, json).otherwise(line)
    return log.select("session_id", *keep, F.when(known_kind(F.col("kind")).isNotNull(), line).alias("line"))


def decode(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with seq, kind, at and the payload fields; a missing payload is an empty one, an unknown kind an error."""
    event = F.from_json(line, f"seq bigint, kind string, at double, payload struct<{PAYLOAD.replace(' ', ':').replace(',:', ',')}>")
    x = lines.withColumn("_event", event)
    return x.select(*(c for c in lines.columns if c != line), "_event.seq", known_kind(F.col("_event.kind")).alias("kind"), "_event.at", "_event.payload.*")


def hello(policy: Column) -> Column:
    """The line before a session's events."""
    return F.to_json(F.struct(F.lit("hello").alias("kind"), policy.alias("policy"), F.lit(VERSION).alias("protocol"), F.lit(SAMPLE_RATE).alias("sample_rate")))


def render(log: DataFrame) -> DataFrame:
    """session_id, seq and a line for people."""
    who = F.coalesce("speaker", F.lit("-"))
    text = (
        F.when(F.col("kind") == "commit", F.format_string("[%s] %s  %+.2f s", who, "text", "delay"))
        .when(F.col("kind") == "partial", F.col("text"))
        .when(F.col("kind") == "turn_start", F.format_string("turn %d, speaker %s", "turn", who))
        .when((F.col("kind") == "speaker") & F.col("target_seq").isNotNull(), F.format_string("word %d is %s", "target_seq", who))
        .when(F.col("kind") == "speaker", F.format_string("turn %d is %s", "turn", who))
        .when(F.col("kind") == "endpoint", F.col("reason"))
        .when(F.col("kind") == "polished", F.format_string("%d..%d  %s", "from_seq", "to_seq", "text"))
        .when(F.col("kind") == "degraded", F.format_string("%s, lag %.2f s", F.when(F.col("degraded"), "dropping partials").otherwise("keeping partials"), "lag"))
        .otherwise("")
    )
    return log.select("session_id", "seq", F.format_string("%3d  %6.2f s  %-12s  %s", "seq", "at", "kind", text).alias("line"))


def word_problem(word: Column) -> Column:
    """Why a word can't stand, or null."""
    return F.when(word["audio_end"] < word["audio_start"] - TOLERANCE, "ends before it starts").when(word["audio_start"] < 0, "starts before the stream")


def segment_problem(segment: Column) -> Column:
    return F.when(segment["end"] < segment["start"], "ends before it starts").when(F.coalesce(F.size(segment["embedding"]), F.lit(0)) <= 0, "no embedding")


def event_problem(seq: Column, at: Column, kind: Column) -> Column:
    return F.when(seq < 0, "negative seq").when(at < 0, "negative at").when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "no such kind")


def quarantine(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are fine, and the others with their problem."""
    marked = df.withColumn("problem", problem)
    return marked.where("problem IS NULL").drop("problem"), marked.where("problem IS NOT NULL")


__all__ = ["FIELDS", "SEGMENT", "VERSION", "WORD", "decode", "encode", "event_problem", "hello", "known_kind", "quarantine", "render", "rounded", "segment_problem", "word_problem"]
