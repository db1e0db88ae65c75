"""Frames of a log written once and in order, whatever fails on the way.

A micro-batch is written below its number, which a repeated batch writes over; then a mark says that it counts.
Readers see marked batches only. So that a query that starts anew, without its checkpoint, repeats nothing, each batch
also leaves the last seq of every session that is still in motion, and rows up to it are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.protocol import encode
from ..sources.recordings import write_recordings


@dataclass
class FrameSink:
    """For writeStream.foreachBatch: events to one JSON line each below path/frames. A session that has been quiet for
    `keep` batches is no longer looked for among rows that come again."""

    path: str
    keep: int = 1000

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark, number = events.sparkSession, self._number(events.sparkSession, batch)
        if number is None:
            return
        heads = self._heads(spark, number - 1)
        events = events.dropDuplicates(["session_id", "seq"])
        if heads is not None:
            last = heads.select("session_id", "last")
            events = events.join(last, "session_id", "left").where("last IS NULL OR seq > last").drop("last")
        lines = encode(events, "seq").repartition("session_id").sortWithinPartitions("session_id", "seq")
        out = f"{self.path}/frames/batch={number}"
        lines.write.mode("overwrite").parquet(out)
        new = spark.read.schema(lines.schema).parquet(out).groupBy("session_id").agg(F.max("seq").alias("last"), F.lit(number).cast("bigint").alias("batch"))
        if heads is not None:
            new = heads.where(F.col("batch") > number - self.keep).unionByName(new).groupBy("session_id").agg(F.max("last").alias("last"), F.max("batch").alias("batch"))
        new.write.mode("overwrite").parquet(f"{self.path}/heads/{number}")
        self._mark(spark, number, batch)
        self._delete(spark, f"{self.path}/heads/{number - 2}")

    def _number(self, spark: SparkSession, batch: int) -> int | None:
        """Numbers go on where an earlier query ended; None for a batch of this query that counts already."""
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "query"
        marks = self._marks(spark)
        if (query, batch) in marks:
            return None
        return len(marks)

    def _marks(self, spark: SparkSession) -> set[tuple[str, int]]:
        return {(q, int(b)) for _, q, b in (name.split(".") for name in self._names(spark, f"{self.path}/marks"))}

    def _mark(self, spark: SparkSession, number: int, batch: int) -> None:
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "query"
        fs, path = self._fs(spark, f"{self.path}/marks/{number}.{query}.{batch}")
        fs.create(path, True).close()

    def _heads(self, spark: SparkSession, number: int) -> DataFrame | None:
        return spark.read.parquet(f"{self.path}/heads/{number}") if number >= 0 else None

    def _fs(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        fs, path = self._fs(spark, folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, spark: SparkSession, folder: str) -> None:
        fs, path = self._fs(spark, folder)
        fs.delete(path, True)

    def frames(self, spark: SparkSession) -> DataFrame:
        """session_id, seq, line of the batches that count."""
        numbers = [name.split(".")[0] for name in self._names(spark, f"{self.path}/marks")]
        schema = "session_id bigint, seq bigint, line string"
        paths = [f"{self.path}/frames/batch={n}" for n in sorted(numbers, key=int)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


@dataclass
class RecordingSink:
    """For writeStream.foreachBatch: audio rows (session_id, chunk_no, pcm) kept once each; a repeated batch writes over
    itself. :meth:`write` makes a file of each session, without a session in one row."""

    path: str

    def __call__(self, frames: DataFrame, batch: int) -> None:
        rows = frames.where("kind = 'audio' AND chunk_no IS NOT NULL").select("session_id", "chunk_no", F.col("pcm").alias("chunk"))
        rows.repartition("session_id").sortWithinPartitions("session_id", "chunk_no").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def chunks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("batch").dropDuplicates(["session_id", "chunk_no"])

    def write(self, spark: SparkSession, folder: str) -> None:
        session = F.col("session_id").cast("string").alias("session")
        write_recordings(self.chunks(spark).select(session, "chunk_no", F.col("chunk").alias("pcm")), folder)
