"""Fixtures with audio: sessions mixed of turns with known places, and pairs of clips cut in mid thought."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import FUNCTION_WORDS
from ..operators.score import endpoint_report
from ..schema import SAMPLE_RATE
from ..streaming.models import TurnDetector, shared_model
from .files import parse_wav, read_files, read_index, write_truth
from .recordings import write_recordings

#: Fixed values of the published fixtures: seconds between turns, most of a turn, behind all; of a clip; where it is cut.
GAP, MOST_TURN, TAIL = 0.7, 10.0, 1.5
CLIP_SECONDS, CLIP_WORDS, CUT = (5.0, 14.0), 8, (0.40, 0.75)


def silence(seconds: float) -> Column:
    return F.unhex(F.repeat(F.lit("0000"), int(seconds * SAMPLE_RATE)))


def samples_of(pcm: Column) -> Column:
    return (F.octet_length(pcm) / 2).cast("bigint")


def mixed(turns: DataFrame, gap: float = GAP, most: float = MOST_TURN, tail: float = TAIL, pcm: Column | None = None, samples: Column | None = None) -> tuple[DataFrame, Column, DataFrame]:
    """Audio rows (session, chunk_no and the rest), the expression of their audio, and truth (session_id, turn_idx, speaker,
    start, end) of turns (session_id, turn_idx, speaker, pcm): cut to `most` seconds, one behind another with a gap, and
    silence at the end. A turn's place is the sum of the samples before it; no row holds more than one turn. Where `pcm` and
    `samples` are expressions of other columns of turns, audio is made of them where it is written, and nowhere else."""
    made = F.col("pcm") if pcm is None else pcm
    n = F.least(samples_of(made) if samples is None else samples, F.lit(int(most * SAMPLE_RATE))).cast("bigint")
    order = Window.partitionBy("session_id").orderBy("turn_idx")
    begin = F.coalesce(F.sum(F.col("n") + int(gap * SAMPLE_RATE)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.withColumn("n", n).withColumn("at", begin).withColumn("last", F.lead("turn_idx").over(order).isNull())
    second = lambda n: F.round(n / SAMPLE_RATE, 3)
    truth = placed.select("session_id", "turn_idx", "speaker", second(F.col("at")).alias("start"), second(F.col("at") + F.col("n")).alias("end"))
    audio = placed.withColumn("session", F.col("session_id").cast("string")).withColumn("chunk_no", F.col("turn_idx").cast("bigint"))
    whole = F.concat(F.substring(made, F.lit(1), (F.col("n") * 2).cast("int")), silence(gap), F.when(F.col("last"), silence(tail)).otherwise(F.lit(b"")))
    return audio, whole, truth


def write_mixed(turns: DataFrame, path: str, parts: int | None = None, **limits) -> None:
    """path/audio/<session>.wav, written by so many tasks, and path/truth/session_id=<session>."""
    turns = turns.persist()  # of both
    audio, pcm, truth = mixed(turns, **limits)
    write_recordings(audio, f"{path}/audio", parts, pcm)
    write_truth(truth, f"{path}/truth")
    turns.unpersist()


def cut_places(clips: DataFrame) -> DataFrame:
    """clips (stem, seconds, words: text and audio_end, and the rest) of a fit length with incomplete, complete, cut_after,
    cut_at and cut_bytes: they are cut behind the first function word in their middle."""
    bare = lambda w: F.regexp_replace(F.lower(w["text"]), r"^[.,]+|[.,]+$", "")
    inside = F.filter("words", lambda w: (w["audio_end"] / F.col("seconds")).between(*CUT) & bare(w).isin(*FUNCTION_WORDS))
    fit = clips.where(F.col("seconds").between(*CLIP_SECONDS) & (F.size("words") >= CLIP_WORDS))
    found = fit.withColumn("at", F.get(inside, F.lit(0))).where("at IS NOT NULL")
    name = lambda kind: F.concat("stem", F.lit(f"_{kind}.wav")).alias(kind)
    size = F.expr(f"CAST(at.audio_end * {SAMPLE_RATE} + 1e-6 AS INT) * 2").alias("cut_bytes")
    return found.select(*clips.columns, name("incomplete"), name("complete"), F.col("at.text").alias("cut_after"), F.round("at.audio_end", 3).alias("cut_at"), size)


def cut_clips(clips: DataFrame) -> DataFrame:
    """stem, incomplete, complete, cut_after, cut_at, pcm and cut of clips (stem, pcm, words: text and audio_end, and their
    seconds if they are known without the audio): those of a fit length, cut behind the first function word in their middle."""
    # a generator's rows are made once; Spark would put the expression of a clip's audio wherever its seconds are asked for,
    # which is at each of its words
    once = lambda df, name, c: df.select(*(x for x in df.columns if x != name), F.explode(F.array(c)).alias(name))
    known = "seconds" in clips.columns
    if not known:
        clips = once(once(clips, "pcm", F.col("pcm")), "seconds", samples_of(F.col("pcm")) / SAMPLE_RATE)
    items = cut_places(clips)
    items = once(items, "pcm", F.col("pcm")) if known else items
    return items.select("stem", "incomplete", "complete", "cut_after", "cut_at", "pcm", F.expr("substring(pcm, 1, cut_bytes)").alias("cut"))


def write_pairs(clips: DataFrame, path: str, tail: float = TAIL, parts: int | None = None, pcm: Column | None = None) -> None:
    """path/index (JSON lines) and path/audio, written by so many tasks: each fit clip whole and cut, with silence behind
    both. Where `pcm` is an expression of other columns of clips and these say their seconds, audio is made where it is
    written, of fit clips only."""
    if pcm is None:
        items, made = cut_clips(clips).withColumn("cut_bytes", F.octet_length("cut")).drop("cut"), F.col("pcm")
    else:
        items, made = cut_places(clips).drop("words").persist(), pcm  # of both
    sides = F.array(F.struct(F.col("incomplete").alias("name"), F.col("cut_bytes").alias("most")), F.struct(F.col("complete").alias("name"), F.lit(None).cast("int").alias("most")))
    both = items.select("*", F.inline(sides)).select(F.regexp_replace("name", r"\.wav$", "").alias("session"), F.lit(0).cast("bigint").alias("chunk_no"), "*")
    side = F.concat(F.when(F.col("most").isNull(), made).otherwise(F.substring(made, F.lit(1), F.col("most"))), silence(tail))
    write_recordings(both, f"{path}/audio", parts, side)
    items.select("stem", "incomplete", "complete", "cut_after", "cut_at").write.mode("overwrite").json(f"{path}/index")
    items.unpersist()


def wav_scores_udf(name: str, make: Callable[[], TurnDetector], tail: float):
    """The bytes of a WAV file to the score of its audio without so much at its end, or the reasons why it has none, in
    one go: audio does not go back and forth between Spark and its workers."""
    silent = int(tail * SAMPLE_RATE) * 2

    @F.pandas_udf("score double, problems array<string>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared_model(("turns", name), make)
        for files in batches:
            heard = [parse_wav(f) for f in files]
            scores = [None if pcm is None else model.completeness("", pcm[: max(len(pcm) - silent, 0)]) for pcm, _ in heard]
            yield pd.DataFrame({"score": pd.Series(scores, dtype=float), "problems": [p for _, p in heard]})

    return scored


def pair_scores(spark: SparkSession, path: str, name: str, make: Callable[[], TurnDetector], tail: float = TAIL, index: str = "index") -> DataFrame:
    """stem, complete, score, problems of both clips of each item of an index folder or file below path, without the
    silence behind them. A clip that is missing or can't be read has no score and says why."""
    items = read_index(spark, f"{path}/{index}", lines=not index.endswith(".json"))
    sides = F.array(*(F.struct(F.col(c).alias("file"), F.lit(c == "complete").alias("complete")) for c in ("incomplete", "complete")))
    asked = items.select("stem", F.inline(sides))
    scored = read_files(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), wav_scores_udf(name, make, tail)("content").alias("w")).select("file", "w.*")
    # scores meet their items, audio stays where it is read
    problems = F.when(F.col("problems").isNull(), F.array(F.lit("no such file"))).otherwise(F.col("problems"))
    return asked.join(scored, "file", "left").select("stem", "complete", "score", problems.alias("problems"))


def gate_report(spark: SparkSession, path: str, name: str, make: Callable[[], TurnDetector], policies: DataFrame, index: str = "index") -> DataFrame:
    """The endpoint report of each policy over an index folder."""
    return scores_report(pair_scores(spark, path, name, make, index=index), policies)


def scores_report(scores: DataFrame, policies: DataFrame) -> DataFrame:
    """The endpoint report of each policy over scores of clips; those without a score count in `unread`."""
    report = endpoint_report(scores.where("score IS NOT NULL").select("score", "complete"), policies)
    return report.crossJoin(F.broadcast(scores.agg(F.count_if(F.col("score").isNull()).alias("unread"))))  # one row
