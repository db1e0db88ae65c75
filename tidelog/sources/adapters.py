"""The log's inputs, derived from the general tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EACH = 0.3
#: Voice segments of a session: sessions grow in number with the table, not in length.
SESSION_ROWS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Letters of conversations whose words, chunk rows or audio frames one task takes: audio is about 220 bytes a letter.
TASK_LETTERS = 1_000_000


#: Letters of conversations whose audio lies in files at once (220 to 300 bytes a letter), and most waves: beyond, they
#: grow with the table, so that the reads of it do not.
WAVE_LETTERS, MOST_WAVES = 4_000_000, 32


def _conversations(spark: SparkSession, sf_dir: str, of: Column | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows if of is None else rows.where(of)


def _letters(spark: SparkSession, sf_dir: str, of: Column | None = None) -> int:
    return _conversations(spark, sf_dir, of).agg(F.sum(F.length("text"))).first()[0] or 0


def session_parts(spark: SparkSession, sf_dir: str, of: Column | None = None) -> int:
    """Partitions for what is derived from conversations: as many as the session's setting, more with the text. Their
    number is given to repartition, since Spark joins small partitions by their compressed size, and audio and rows of words
    are many times larger in a task's memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_letters(spark, sf_dir, of) // TASK_LETTERS))


def waves(spark: SparkSession, sf_dir: str) -> list[Column]:
    """Conditions on conversations, of which each holds for about the same share of its sessions, and one for each
    session: whole recordings of a wave lie in files at once, those of all sessions never."""
    n = min(MOST_WAVES, max(1, -(-_letters(spark, sf_dir) // WAVE_LETTERS)))
    return [F.pmod(F.xxhash64("conv_id"), F.lit(n)) == k for k in range(n)]


def words(spark: SparkSession, sf_dir: str, of: Column | None = None) -> DataFrame:
    """One row per word of conversations, or of those that a wave is of, timed by its running number g in the conversation."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    raw = _conversations(spark, sf_dir, of).select("conv_id", "turn", "role", F.posexplode(F.split(text, r"\s+")).alias("pos", "word")).where("word <> ''")
    order = Window.partitionBy("conv_id").orderBy("turn", "pos")
    g = raw.repartition(session_parts(spark, sf_dir, of), "conv_id").withColumn("g", (F.row_number().over(order) - 1).cast("bigint"))
    own = (F.col("g") + 1) * EACH + F.lit(0.1) * (1 + F.col("g") % 7)
    plain = F.when(F.col("role") == "user", "A").when(F.col("role") == "assistant", "B")
    swapped = F.when(F.col("role") == "user", "B").when(F.col("role") == "assistant", "A")
    by_g = Window.partitionBy("conv_id").orderBy("g")
    return g.select(
        "conv_id",
        "turn",
        "role",
        "g",
        "word",
        (F.col("g") * EACH).alias("audio_start"),
        ((F.col("g") + 1) * EACH).alias("audio_end"),
        F.max(own).over(by_g).alias("emitted_at"),
        (0.5 + (F.col("g") * 7919 % 50) / 100).alias("confidence"),
        F.when(F.col("g") % 11 == 0, None).when(F.col("g") % 17 == 0, swapped).otherwise(plain).alias("predicted"),
    )


def truth_turns(cw: DataFrame) -> DataFrame:
    return cw.groupBy("conv_id", "turn").agg(F.min("audio_start").alias("start"), F.max("audio_end").alias("end"), F.min("role").alias("speaker"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    e = e.withColumn("session", F.col("vec_id") % max(10, e.count() // SESSION_ROWS))
    i = F.row_number().over(Window.partitionBy("session").orderBy("vec_id")) - 1
    return (
        e.withColumn("i", i.cast("bigint"))
        .withColumn("start", 2.0 * F.col("i"))
        .withColumn("end", F.col("start") + 1.0 + 0.4 * (F.col("i") % 5))
        .withColumn("overlap", F.col("vec_id") % 13 == 0)
        .select("session", "i", "vec_id", "start", "end", "overlap", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    )


#: Samples of a word's audio, the level of speech, half periods by role, and how many words of each 40 are a pause.
WORD_SAMPLES, LOUD, HALF_PERIODS, PAUSE_WORDS = 640, 2000, (8, 16, 32), 20


def _wave(level: int, half: int) -> str:
    """One period of a square wave as the hex text of 16-bit samples."""
    return (level.to_bytes(2, "little", signed=True) * half + (-level).to_bytes(2, "little", signed=True) * half).hex()


def _quiet() -> Column:
    return F.col("g") % 40 >= 40 - PAUSE_WORDS


def _sounds() -> Column:
    return F.array(*(F.lit(_wave(a, h) * (WORD_SAMPLES // 2 // h)) for a in (20, 40, 60, 80, 100, LOUD) for h in HALF_PERIODS))


def word_sound() -> Column:
    """The number of a word's sound, of which :func:`sound_pcm` makes its audio: a byte, where the audio is 1,280."""
    half = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    level = F.when(_quiet(), F.col("turn") % 5).otherwise(5)
    return (level * len(HALF_PERIODS) + half).cast("int")


def sound_pcm(sounds: Column) -> Column:
    """The audio of words behind each other, by the numbers of their sounds."""
    waves = _sounds()
    return F.unhex(F.array_join(F.transform(sounds, lambda s: F.get(waves, s)), ""))


def audio_frames(spark: SparkSession, sf_dir: str, of: Column | None = None) -> DataFrame:
    """conversations as frames of audio, one for each word: a square wave, its pitch by role, with pauses of low noise
    that is louder from turn to turn. Words come with their frames; a frame ends each session."""
    w = words(spark, sf_dir, of)
    quiet = _quiet()
    order = Window.partitionBy("conv_id").orderBy("g")
    word = F.struct(F.col("word").alias("text"), (F.col("g") * 0.04).alias("audio_start"), ((F.col("g") + 1) * 0.04).alias("audio_end"), "confidence")
    said = F.when(~quiet, word)
    before = F.last(said, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    frames = w.select(
        F.col("conv_id").alias("session_id"), F.col("g").alias("chunk_no"), F.lit("audio").alias("kind"), F.unhex(F.get(_sounds(), word_sound())).alias("pcm"), F.lit(0.1).alias("lag"),
        F.when(~quiet & before.isNotNull(), F.array(before)).alias("words"), F.when(~quiet, F.array(word)).alias("tentative"), F.lit(False).alias("fragment"),
    )
    ends = w.groupBy("conv_id").agg((F.max("g") + 1).alias("chunk_no")).withColumnRenamed("conv_id", "session_id").withColumn("kind", F.lit("finish"))
    return frames.unionByName(ends, allowMissingColumns=True)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log per user: at in seconds since the user's first event."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.create_map(*(F.lit(x) for x in ("click", "commit", "view", "partial", "purchase", "endpoint", "signup", "turn_start", "error", "speaker")))
    at = (us - F.min(us).over(Window.partitionBy("user_id"))) / F.lit(1e6)
    return e.select("user_id", "event_id", kind[F.col("event_type")].alias("kind"), at.alias("at"), (F.col("value") / 100).alias("lag"), "props")


#: The same rows in DuckDB: common table expressions.
CW_SQL = r"""
w0 AS (SELECT conv_id, turn, role, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM
  (SELECT conv_id, turn, role, regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS l FROM conversations)),
w1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS g FROM w0 WHERE word <> ''),
cw AS (SELECT conv_id, turn, role, g, word, g * 0.3::DOUBLE AS audio_start, (g + 1) * 0.3::DOUBLE AS audio_end,
  max((g + 1) * 0.3::DOUBLE + 0.1::DOUBLE * (1 + g % 7)) OVER (PARTITION BY conv_id ORDER BY g) AS emitted_at,
  0.5::DOUBLE + (g * 7919 % 50) / 100::DOUBLE AS confidence,
  CASE WHEN g % 11 = 0 THEN NULL WHEN g % 17 = 0 THEN CASE role WHEN 'user' THEN 'B' WHEN 'assistant' THEN 'A' END
    ELSE CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' END END AS predicted FROM w1),
ct AS (SELECT conv_id, turn, min(audio_start) AS "start", max(audio_end) AS "end", min(role) AS speaker FROM cw GROUP BY ALL)"""
SEG_SQL = """
n0 AS (SELECT greatest(10, count(*) // 200) AS n FROM embeddings),
s0 AS (SELECT vec_id % n AS session, vec_id, label::INT AS label, embedding::DOUBLE[] AS embedding,
  row_number() OVER (PARTITION BY vec_id % n ORDER BY vec_id) - 1 AS i FROM embeddings, n0),
seg AS (SELECT session, i, vec_id, 2.0::DOUBLE * i AS "start", 2.0::DOUBLE * i + 1.0::DOUBLE + 0.4::DOUBLE * (i % 5) AS "end",
  vec_id % 13 = 0 AS overlap, label, embedding FROM s0)"""
EV_SQL = """
ev AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'commit' WHEN 'view' THEN 'partial' WHEN 'purchase' THEN 'endpoint'
  WHEN 'signup' THEN 'turn_start' WHEN 'error' THEN 'speaker' END AS kind,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS "at", value / 100 AS lag, props FROM events)"""
