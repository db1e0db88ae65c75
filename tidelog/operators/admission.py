"""Admission of sessions by a limit of those at once, over a whole table.

Whether a session is let in depends on all that were let in before it: a sweep in order of time. Each server's time
is cut into buckets, and a bucket's sweep needs of the past only the ends of the sessions that are open as it begins,
at most `limit` of them. All buckets are swept at once from what is known of that. If the past of one turns out
otherwise, all are swept again, eight neighbours as one bucket, until nothing changes: as sessions are short beside a
bucket, mostly after two or three rounds, and in any case after a third as many as the number of buckets has bits.
"""

from __future__ import annotations

import heapq
import os
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket: what one task sweeps at a time.
BUCKET_ROWS = 50_000
#: A bucket's time in sessions of average length, at least.
SESSIONS_LONG = 8
#: So many bits of a bucket's number go from round to round.
MERGED = 3


def default_limit() -> int:
    """Sessions at once where nothing else is said: the cores of the machine, from 2 to 16."""
    return max(2, min(16, os.cpu_count() or 2))


def sweep(rows: list[tuple[float, float]], limit: int, open_ends: list[float]) -> tuple[list[bool], list[float]]:
    """Which of the sessions (start, end), in order, are let in beside those open, and the ends of all let in. While the
    server is full nothing is let in, so that the sweep goes on with the first session behind the next end."""
    starts, out, at = [start for start, _ in rows], [False] * len(rows), 0
    ends = list(open_ends)
    heapq.heapify(ends)
    while at < len(rows) and limit > 0:
        while ends and ends[0] <= starts[at]:
            heapq.heappop(ends)
        if len(ends) < limit:
            out[at] = True
            heapq.heappush(ends, rows[at][1])
            at += 1
        else:
            at = bisect_left(starts, ends[0], at + 1)
    return out, sorted(ends)


def admitted(sessions: DataFrame, limit: int, by: str = "server", key: str = "session_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """by, key, start, end, admitted: sessions ask in the order of start, then key; one is refused, not queued, while
    `limit` of its server are open. A session is open from its start until before its end. Null times are refused."""
    spark = sessions.sparkSession
    from ..plans.runner import shared_root

    root = shared_root(spark, "admission")
    asked = sessions.select(by, key, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    timed = asked.where("start IS NOT NULL AND end IS NOT NULL")
    # buckets of equal time: as many as a server's rows ask for, but each much longer than a session is on the average
    long = F.avg(F.greatest(F.col("end") - F.col("start"), F.lit(0.0)))
    span = timed.groupBy(by).agg(F.min("start").alias("low"), F.max("start").alias("high"), F.ceil(F.count("*") / bucket_rows).alias("n"), long.alias("long"))
    most = F.when(F.col("long") > 0, F.floor((F.col("high") - F.col("low")) / (SESSIONS_LONG * F.col("long")))).otherwise(F.col("n"))
    span = span.select(by, "low", "high", F.greatest(F.least("n", most), F.lit(1)).alias("n"))
    place = F.least(F.floor((F.col("start") - F.col("low")) * F.col("n") / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))), F.col("n") - 1)
    dealt = timed.join(span, by).withColumn("place", place.cast("bigint")).drop("low", "high", "n")
    # numbered without those that have no row
    numbers = dealt.select(by, "place").distinct().withColumn("bucket", (F.row_number().over(Window.partitionBy(by).orderBy("place")) - 1).cast("bigint"))
    dealt.join(numbers, [by, "place"]).drop("place").write.parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")
    schema = f"`{by}` {rows.schema[by].dataType.simpleString()}, bucket bigint, ends array<double>"
    known = spark.createDataFrame([], schema)
    for turn in range(1 << 30):
        _swept(rows.withColumn("bucket", F.shiftright("bucket", MERGED * turn)), known, by, key, limit).write.parquet(f"{root}/{turn}")
        done = spark.read.parquet(f"{root}/{turn}")
        behind = done.where("last").select(by, (F.col("bucket") + 1).alias("bucket"), "ends")
        new = behind.join(done.select(by, "bucket").distinct(), [by, "bucket"], "left_semi").where("size(ends) > 0")
        wrong = new.join(known.withColumnRenamed("ends", "was"), [by, "bucket"], "full").where("NOT (ends <=> was)")
        if wrong.isEmpty():
            break
        # the next round's buckets are eight of this one's
        known = new.where(F.col("bucket") % (1 << MERGED) == 0).withColumn("bucket", F.shiftright("bucket", MERGED))
    swept = done.select(by, key, "start", "end", "admitted")
    return swept.unionByName(asked.where("start IS NULL OR end IS NULL").withColumn("admitted", F.lit(False)))


def _swept(rows: DataFrame, known: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """Each bucket swept from the ends that are known to be open as it begins; its last row has those behind it."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = (by, key, "start", "end", "bucket")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", admitted boolean, last boolean, ends array<double>"

    def told(part: pa.RecordBatch, admitted: list[bool], ends: list[float] | None) -> pa.RecordBatch:
        """ends: those behind a bucket, where the part is its end."""
        n = part.num_rows
        behind = pa.array([None] * (n - 1) + [ends], pa.list_(pa.float64()))
        columns = [*(part.column(c) for c in names), pa.array(admitted), pa.array([False] * (n - 1) + [ends is not None]), behind]
        return pa.RecordBatch.from_arrays(columns, [*names, "admitted", "last", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, held = None, [], None
        for batch in batches:
            for part in _runs(batch, by):
                place = (part.column(by)[0].as_py(), part.column("bucket")[0].as_py())
                if place != now:
                    if held is not None:
                        yield told(*held, ends)
                    now, ends, held = place, [], None
                if not part.column("start")[0].is_valid:  # what is known stands in front
                    ends, part = part.column("was")[0].as_py(), part.slice(1)
                if not part.num_rows:
                    continue
                if held is not None:
                    yield told(*held, None)
                admitted, ends = sweep(list(zip(part.column("start").to_pylist(), part.column("end").to_pylist(), strict=True)), limit, ends)
                held = (part, admitted)
        if held is not None:
            yield told(*held, ends)

    both = rows.select(*names).unionByName(known.withColumnRenamed("ends", "was"), allowMissingColumns=True)
    return both.repartition(by, "bucket").sortWithinPartitions(by, "bucket", "start", key).mapInArrow(run, schema)


def _runs(batch: pa.RecordBatch, by: str) -> Iterator[pa.RecordBatch]:
    """The stretches of a batch that lie in one bucket."""
    n = batch.num_rows
    if not n:
        return
    changes = [pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in (by, "bucket")]
    edges = [0, *((changes[0] | changes[1]).nonzero()[0] + 1).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)
