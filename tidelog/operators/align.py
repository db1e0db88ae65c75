"""Labels for words: truth by position, overlap with segments, nearest segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import overlap

#: Seconds per bucket of the time-bucketed joins: a long session spreads over many keys.
BUCKET = 30.0


def _bucketed(df: DataFrame, start: str, end: str, pad: float = 0.0) -> DataFrame:
    """A row per time bucket that start - pad to end + pad touches."""
    lo, hi = F.floor((F.col(start) - pad) / BUCKET), F.floor((F.col(end) + pad) / BUCKET)
    return df.withColumn("_b", F.explode(F.sequence(lo, hi)))


def at_point(words: DataFrame, turns: DataFrame, session: str) -> DataFrame:
    """words with truth: speaker of the first turn (by turn_idx) whose closed interval holds the word's middle."""
    mid = words.withColumn("mid", (F.col("audio_start") + F.col("audio_end")) / 2).withColumn("_b", F.floor(F.col("mid") / BUCKET))
    t = _bucketed(turns.select(F.col(session), "start", "end", "turn_idx", F.col("speaker").alias("_sp")), "start", "end")
    hit = mid.join(t, [session, "_b"]).where(F.col("mid").between(F.col("start"), F.col("end")))
    first = hit.groupBy(session, "g").agg(F.min_by("_sp", "turn_idx").alias("truth"))
    return words.join(first, [session, "g"], "left")


def by_overlap(words: DataFrame, segs: DataFrame, session: str) -> DataFrame:
    """session, g, label, overlap of the segment that overlaps the word most, the earliest of equals."""
    w, s = _bucketed(words, "audio_start", "audio_end"), _bucketed(segs, "start", "end")
    both = w.join(s, [session, "_b"]).withColumn("overlap", F.round(overlap(F.col("audio_start"), F.col("audio_end"), F.col("start"), F.col("end")), 6)).where("overlap > 0")
    best = F.max_by(F.struct("label", "overlap"), F.struct("overlap", -F.col("i"))).alias("x")
    return both.groupBy(session, "g").agg(best).select(session, "g", "x.label", "x.overlap")


def by_neighbours(words: DataFrame, segs: DataFrame, session: str, max_gap: float = 2.0) -> DataFrame:
    """Label of words that overlap no segment: the nearest before and after within max_gap, null if they differ."""
    free = words.join(by_overlap(words, segs, session).select(session, "g"), [session, "g"], "left_anti")
    w, s = _bucketed(free, "audio_start", "audio_end", max_gap), _bucketed(segs, "start", "end")
    both = w.join(s, [session, "_b"]).dropDuplicates([session, "g", "i"])
    before, after = F.round(F.col("audio_start") - F.col("end"), 6), F.round(F.col("start") - F.col("audio_end"), 6)
    near = both.groupBy(session, "g").agg(
        F.max_by("label", F.when((before >= 0) & (before <= max_gap), F.struct("end", "i"))).alias("left"),
        F.min_by("label", F.when((after >= 0) & (after <= max_gap), F.struct("start", "i"))).alias("right"),
    )
    label = F.when(F.col("left").isNull(), F.col("right")).when(F.col("right").isNull() | (F.col("left") == F.col("right")), F.col("left"))
    return free.select(session, "g").join(near, [session, "g"], "left").select(session, "g", "left", "right", label.alias("label"))


def centroids(segs: DataFrame, by: str, weight: str) -> DataFrame:
    """Weighted mean vector of each group; weights that sum to 0 divide by 1."""
    total = F.sum("w")
    mean = F.sum(F.col("v") * F.col("w")) / F.when(total == 0, 1.0).otherwise(total)
    parts = segs.select(by, F.col(weight).alias("w"), F.posexplode("embedding").alias("pos", "v")).groupBy(by, "pos").agg(mean.alias("v"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("centroid"))


def ring_mean(segs: DataFrame, session: str, order: str, value: str, size: int = 24) -> DataFrame:
    w = Window.partitionBy(session).orderBy(order).rowsBetween(-(size - 1), 0)
    return segs.withColumn("ring_mean", F.avg(value).over(w))


def survivors(merges: DataFrame, root: str) -> DataFrame:
    """label, survivor, hops of merges (label, target), one for each label: where its chain ends. Chains are followed by
    doubling, so the longest takes as many rounds as its length has bits; a chain into a cycle ends on it. Each round's
    table lies below root."""
    spark = merges.sparkSession
    merges.select("label", "target", F.lit(1).cast("bigint").alias("hops")).write.parquet(f"{root}/0")
    now = spark.read.parquet(f"{root}/0")
    for turn in range(1, now.count().bit_length() + 1):
        ahead = now.select(F.col("label").alias("target"), F.col("target").alias("further"), F.col("hops").alias("more"))
        step = now.join(ahead, "target", "left")
        step.select("label", F.coalesce("further", "target").alias("target"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("further").isNotNull().alias("moved")).write.parquet(f"{root}/{turn}")
        now = spark.read.parquet(f"{root}/{turn}")
        if now.where("moved").isEmpty():
            break
    return now.select("label", F.col("target").alias("survivor"), "hops")
