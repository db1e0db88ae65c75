"""The coordinator over a table of chunk rows: in batch per session, and as a stream with keyed state."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..policy import Policy
from ..schema import EVENT
from ..sources.adapters import session_parts, waves, words
from ..streaming.lifecycle import event_table, session_events, table_dicts
from ..streaming.state import Coordinator


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinator input from conversations. A row per word shows it as tentative and makes the word before it final;
    behind each turn a voice segment and 2, 4 or 7 rows of silence, 0.3 s apart, so that an utterance goes on, is
    complete by its score or times out. The last word of a turn is settled by silence or comes with the next turn.
    Here and there two words become a spoken number, which the chain writes in digits."""
    from pyspark.sql import Window

    w = words(spark, sf_dir)
    quiet_rows = F.element_at(F.array(F.lit(2), F.lit(4), F.lit(7)), (F.col("turn") % 3 + 1).cast("int"))
    turns = w.groupBy("conv_id", "turn", "role").agg(F.max("g").alias("g"), F.min("audio_start").alias("s"), F.max("audio_end").alias("e"), F.max("emitted_at").alias("own_at"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("rows", quiet_rows).withColumn("pause", F.coalesce(F.sum(F.col("rows") * 0.3).over(before), F.lit(0.0)))
    said = F.when(F.col("g") % 20 == 9, "twenty").when(F.col("g") % 20 == 10, "five").otherwise(F.col("word"))
    word = F.struct(said.alias("text"), "audio_start", "audio_end", "confidence")
    none_w = F.lit(None).cast("array<struct<text:string,audio_start:double,audio_end:double,confidence:double>>")
    none_s = F.lit(None).cast("array<struct<start:double,end:double,embedding:array<double>,overlap:boolean>>")
    final = F.lag(word).over(Window.partitionBy("conv_id").orderBy("g"))
    spoken = w.withColumn("final", final).join(turns.select("conv_id", "turn", "pause"), ["conv_id", "turn"])
    at = F.greatest(F.col("audio_end"), F.col("emitted_at")) + F.col("pause")
    spoken = spoken.select("conv_id", "turn", "g", F.lit(0).alias("part"), at.alias("own_at"), F.lit(True).alias("speaking"), F.when(F.col("final").isNotNull(), F.array("final")).alias("words"), F.array(word).alias("tentative"), none_s.alias("segments"))
    voice = F.when(F.col("role") == "user", F.array(*map(F.lit, (1.0, 0.0, 0.0)))).when(F.col("role") == "assistant", F.array(*map(F.lit, (0.0, 1.0, 0.0)))).otherwise(F.array(*map(F.lit, (0.0, 0.0, 1.0))))
    seg = F.array(F.struct(F.col("s").alias("start"), F.col("e").alias("end"), voice.alias("embedding"), (F.col("turn") % 5 == 4).alias("overlap")))
    quiet = turns.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    quiet = quiet.select("conv_id", "turn", "g", "part", (F.col("own_at") + F.col("pause") + 0.3 * F.col("part")).alias("own_at"), F.lit(False).alias("speaking"), none_w.alias("words"), none_w.alias("tentative"), F.when(F.col("part") == 1, seg).alias("segments"))
    order = Window.partitionBy("conv_id").orderBy("g", "part")
    return spoken.union(quiet).repartition(session_parts(spark, sf_dir), "conv_id").select(
        F.col("conv_id").alias("session_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("chunk_no"),
        F.max("own_at").over(order).alias("at"),  # the clock never goes back
        "speaking",
        F.when(F.col("g") % 97 == 96, 2.0).otherwise(0.1).alias("lag"),
        ((F.col("turn") * 53 + F.col("conv_id") * 31) % 100 / 100).alias("score"),
        "words",
        "tentative",
        "segments",
        F.lead("g").over(order).isNull().alias("last"),
        F.lit(False).alias("fragment"),
    )


def run_batch(chunks: DataFrame, policy: Policy) -> DataFrame:
    """The log of every session. A session is one task's work, as its events depend on all before them."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        c = Coordinator(policy)
        return event_table(key[0].as_py(), [e for r in table_dicts(rows) for e in c.push(r)])

    return chunks.groupBy("session_id").applyInArrow(one, EVENT)


def run_stream(chunks: DataFrame, policy: Policy, idle: float | None = None) -> DataFrame:
    """The same log from a streaming DataFrame of chunk rows; see :func:`session_events`."""
    return session_events(chunks, policy, idle)


def shared_root(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/tidelog-{name}-{uuid.uuid4().hex}"


def in_waves(spark: SparkSession, sf_dir: str, name: str, run: Callable[[Column, str], DataFrame]) -> DataFrame:
    """The rows of run(condition on conversations, folder) for one wave of sessions behind another. What a wave writes to its
    folder, and its shuffles, are gone once its rows are saved: the disk holds the files of one wave, whatever the sessions."""
    root, schema = shared_root(spark, name), None
    for k, of in enumerate(waves(spark, sf_dir)):
        rows = run(of, f"{root}/wave-{k}")
        schema = rows.schema
        rows.write.mode("append").parquet(f"{root}/rows")
        del rows
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/wave-{k}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        gc.collect()
        spark._jvm.System.gc()  # Spark drops the shuffle files of finished steps when the driver collects its garbage
    return spark.read.schema(schema).parquet(f"{root}/rows")


#: How far rows can lie behind the newest one and still count; files of one step can fall into two triggers.
LATE_SECONDS = 30


def as_source(rows: DataFrame, root: str, parts: int, idle: float, files: int | None = None) -> DataFrame:
    """A table of rows with chunk_no as a streaming DataFrame of so many steps, which mix the order of chunks, and a last
    one that only moves the clock on, beyond every session's timer. files: of a step, each written by a task; else as many
    as tasks run at once."""
    spark = rows.sparkSession
    files = files or max(4, spark.sparkContext.defaultParallelism)
    for k in range(parts):
        arrived = F.timestamp_seconds(F.lit(float(k + 1))).alias("arrived")
        rows.where(F.col("chunk_no") % parts == k).select("*", arrived).coalesce(files).write.mode("append").parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    tick = {"session_id": "CAST(-1 AS BIGINT)", "arrived": f"timestamp_seconds({parts + LATE_SECONDS + 3 * idle})"}
    spark.range(1).selectExpr(*(f"{tick.get(f.name, f'CAST(NULL AS {f.dataType.simpleString()})')} AS `{f.name}`" for f in schema)).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in").withWatermark("arrived", f"{LATE_SECONDS} seconds")


def saved(rows: DataFrame, name: str) -> DataFrame:
    """The rows from a table of their own: what reads them several times doesn't derive them anew."""
    root = shared_root(rows.sparkSession, name)
    rows.write.parquet(f"{root}/rows")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/rows")


def stream_log(chunks: DataFrame, policy: Policy, parts: int = 3, idle: float = 60.0) -> DataFrame:
    """Replays a table of chunk rows as a stream into a table and reads it back."""
    root = shared_root(chunks.sparkSession, "stream")
    source = as_source(chunks, root, parts, idle)
    query = run_stream(source, policy, idle).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/log")
    query.awaitTermination()
    return chunks.sparkSession.read.schema(EVENT).parquet(f"{root}/log")
